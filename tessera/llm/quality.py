"""Quality by hierarchical empirical Bayes.

Two logistic classifiers, for quality and for toxicity, give each document's evidence
as log-odds. They are fitted on a bounded sample of labelled rows (SAMPLE). One half
of it finds the words and word beginnings that toxic documents use, the other
half fits the weights.

Each document belongs to a host and, in it, to a path. The mean of its documents'
probabilities is a host's, then a path's, estimate, shrunk towards the mean one level
up as if that had been seen kappa times more; kappa comes from how much groups
differ beyond chance (method of moments). A document's posterior log-odds are its
own evidence plus how far its path's posterior lies from the global prior. All
documents count in the means, by grouped aggregation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches_of, in_bitmap, materialize, read_table, row_keys, scratch, spread

#: Labelled rows that the classifiers are fitted on at most; those of least hash.
SAMPLE = 20_000
#: Words and word beginnings kept as signs of toxicity at most.
LEXICON = 4_000
#: Parts into which the documents of one path are dealt for the join with its figures.
SALTS = 32
CLIP = 30.0
_WORDS = re.compile(r"[^\W\d_]+").findall
_TOXIC_FEATURES = 6


def text_features(text: str) -> list[float]:
    """Size, kinds of characters, and how much words and lines repeat."""
    data = text.encode()
    n = len(data) + 1
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words, lines = text.split(), text.split("\n")
    n_words, counts = len(words) + 1, Counter(words)
    signs = lambda chars: float(kinds[list(chars)].sum())
    return [
        np.log(n), np.log(n_words), float(kinds[65:91].sum()), float(kinds[97:123].sum()), float(kinds[48:58].sum()),
        signs(b"|"), signs(b"!"), signs(b"#$%&*"), signs(b".,:;"), signs(b"<>"), float(kinds[128:].sum()),
        n / n_words / 10, len(counts) / n_words, sum(map(str.__eq__, words, words[1:])) / n_words, max(counts.values(), default=0) / n_words,
        len(set(lines)) / len(lines), np.log(len(lines)), min(max(map(len, counts), default=0), 100) / 50,
    ]


def beginnings(text: str) -> set[str]:
    """The words of a text in lower case, and their beginnings of 4 to 8 letters."""
    words = set(_WORDS(text.lower()))
    return words.union(w[:k] + "*" for w in words for k in range(4, min(9, len(w))))


@dataclass
class Head:
    """A logistic model on standardized features and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Head:
        head = cls(x.mean(0), x.std(0) + 1e-6, np.zeros(0))
        z = head._design(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -CLIP, CLIP)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        head.weights = w
        return head

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, np.minimum(z * z, 9)), axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -CLIP, CLIP)


@dataclass
class Model:
    """A head is None where the sample has not both classes: its evidence is then
    0 for quality and -CLIP for toxicity, so that nothing is rejected."""

    quality: Head | None = None
    toxic: Head | None = None
    lexicon: dict[str, float] = field(default_factory=dict)

    def features(self, text: str) -> list[float]:
        hits = [s for w in beginnings(text) if (s := self.lexicon.get(w)) is not None]
        strong = sum(s > 4 for s in hits)
        own = text_features(text)
        return [*own, float(np.log1p(len(hits))), float(np.log1p(sum(hits))), max(hits, default=0.0), float(np.log1p(strong)), strong / (1 + own[1]), own[1]]

    def evidence(self, rows: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows, float).reshape(len(rows), -1)
        q = self.quality.log_odds(x[:, :-_TOXIC_FEATURES]) if self.quality else np.zeros(len(x))
        t = self.toxic.log_odds(x[:, -_TOXIC_FEATURES:]) if self.toxic else np.full(len(x), -CLIP)
        return q, t


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The sample: doc_id, quality, toxic, the half each row falls in, and text, the
    least where rows share the doc_id."""
    some = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id")
        .limit(sample)
        .select("doc_id", "quality", "toxic", F.pmod("h", F.lit(2)).alias("half"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # bounded by sample
    return texts.groupBy(*some.columns).agg(F.min("text").alias("text"))


def _find_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and beginnings that toxic texts use far more: their log-odds ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for batch in batches:
            for text, is_toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                (toxic if is_toxic else clean).update(beginnings(text or ""))
        words = list(toxic | clean)
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.record_batch([pa.array(part), pa.array([toxic[w] for w in part], pa.int64()), pa.array([clean[w] for w in part], pa.int64())], names=["word", "toxic", "clean"])

    totals = rows.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).head()
    counts = rows.where("toxic is not null").select("text", "toxic").mapInArrow(count, "word string, toxic long, clean long")
    a, b = F.sum("toxic") + 0.5, F.sum("clean") + 0.5
    score = F.log(a / (totals["t"] + 1.0)) - F.log(b / (totals["c"] + 1.0))
    best = counts.groupBy("word").agg(score.alias("score"), (score / F.sqrt(1 / a + 1 / b)).alias("z"), F.sum("toxic").alias("n")).where("n >= 4 and z > 3 and score > 2.5")
    return {r["word"]: r["score"] for r in best.orderBy(F.desc("z"), "word").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from a bounded sample of labelled documents. Labels without a
    document, null labels and repeated rows do no harm."""
    rows = materialize(_labelled(docs, labels, sample), "quality-sample")
    model = Model(lexicon=_find_lexicon(rows.where("half = 0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 4 << 20):
            x = [model.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("quality"), batch.column("toxic"), batch.column("half")], names=["x", "quality", "toxic", "half"])

    kinds = rows.select("text", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), "half")
    got = kinds.mapInArrow(run, "x array<double>, quality int, toxic int, half long").collect()
    for name, part in (("quality", slice(None, -_TOXIC_FEATURES)), ("toxic", slice(-_TOXIC_FEATURES, None))):
        known = [r for r in got if r[name] is not None and (name == "quality" or r["half"] == 1)]
        if len({r[name] for r in known}) == 2:
            setattr(model, name, Head.fit(np.array([r["x"] for r in known])[:, part], np.array([float(r[name] == 1) for r in known])))
    return model


def _keys() -> list[Column]:
    return row_keys(F.col("source"), F.col("lang"))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(ord, rk, host, path, quality, toxic): each row's evidence as log-odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", 4 << 20):
            q, t = model.evidence([model.features(x or "") for x in batch.column("text").to_pylist()])
            kept = [batch.column(c) for c in ("ord", "rk", "host", "path")]
            yield pa.record_batch([*kept, pa.array(q), pa.array(t)], names=["ord", "rk", "host", "path", "quality", "toxic"])

    # A source may be a name, a host with a path, or a URL; sections by language are paths.
    place = F.regexp_replace(F.coalesce("source", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.substring_index(place, "/", 1)
    folder = F.when(F.contains(place, F.lit("/")), F.regexp_replace(place, "[^/]*$", "")).otherwise(place)
    rows = docs.select(*_keys(), host.alias("host"), F.concat_ws("/", folder, F.coalesce("lang", F.lit(""))).alias("path"), "text")
    return spread(rows).mapInArrow(run, "ord long, rk long, host string, path string, quality double, toxic double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _kappa(groups: DataFrame, mean: str, parent: str) -> float:
    """How many documents the prior of a level counts for."""
    r = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g"),
        F.sum(F.col("ss") - F.col("n") * F.col(mean) * F.col(mean)).alias("within"),
        F.sum(F.col("n") * F.pow(F.col(mean) - F.col(parent), 2)).alias("between"),
        F.avg(F.col(parent) * (1 - F.col(parent))).alias("spread"),
    ).head()
    if not r["n"] or r["n"] <= r["g"] or r["n"] * r["n"] == r["nn"]:
        return 1e6
    variance = (r["between"] - (r["g"] - 1) * max(r["within"], 0) / (r["n"] - r["g"])) / (r["n"] - r["nn"] / r["n"])
    return float(min(max(r["spread"] / variance - 1 if variance > 1e-9 else 1e6, 1.0), 1e6))


def shifts(scored: DataFrame, column: str) -> DataFrame:
    """(host, path, shift): what each path's posterior adds to log-odds."""
    p = _sigmoid(F.col(column))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).head()
    prior = total["s"] / total["n"] if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).withColumns({"mean": F.col("s") / F.col("n"), "prior": F.lit(float(prior))})
    k = _kappa(hosts, "mean", "prior")
    hosts = hosts.select("host", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_mean"))
    paths = paths.join(hosts, "host").withColumn("mean", F.col("s") / F.col("n"))
    k = _kappa(paths, "mean", "host_mean")
    return paths.select("host", "path", (_logit((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)) - _logit(F.lit(float(prior)))).alias("shift"))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """One row per row of docs: ord (doc_id, nulls as the least long) and rk, which
    tell rows apart (common.row_keys), host, path, quality_evidence, toxic_evidence, p_quality, p_toxic, keep.

    Null texts, sources and languages are empty. Rows that repeat are scored each.
    Without labels of both kinds nothing is rejected. Other columns are ignored; an
    empty table gives an empty result.
    """
    scored = materialize(evidence(docs, fit(docs, labels, sample)), "quality-evidence")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("ord", "rk"), F.lit(SALTS)))
    both = shifts(scored, "quality").withColumnRenamed("shift", "shift_q").join(shifts(scored, "toxic").withColumnRenamed("shift", "shift_t"), ["host", "path"])
    spread = both.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = salted.join(spread, ["host", "path", "salt"]).select(
        "ord", "rk", "host", "path", F.col("quality").alias("quality_evidence"), F.col("toxic").alias("toxic_evidence"),
        _sigmoid(F.col("quality") + F.col("shift_q")).alias("p_quality"), _sigmoid(F.col("toxic") + F.col("shift_t")).alias("p_toxic"),
    )
    return out.withColumn("keep", (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, columns as they are. Each row is judged for
    itself, with or without a doc_id of its own; rows equal in doc_id, text, source
    and lang have one score."""
    with scratch(docs.sparkSession, "quality-rejected"):
        rejected = materialize(score(docs, labels, sample).where("not keep").select("ord", "rk").distinct(), "quality-rejected")
    row, member = F.xxhash64(*_keys()), F.xxhash64("ord", "rk")
    spared = in_bitmap(docs, row, rejected, member, keep=False)
    ord_, rk = _keys()
    doubtful = in_bitmap(docs, row, rejected, member).withColumns({"__ord": ord_, "__rk": rk})
    bad = rejected.withColumnsRenamed({"ord": "__ord", "rk": "__rk"}).hint("merge")
    return spared.unionByName(doubtful.join(bad, ["__ord", "__rk"], "left_anti").drop("__ord", "__rk"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    scores = score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    doc_id = F.when(F.col("ord") != -(1 << 63), F.col("ord"))
    return scores.select(doc_id.alias("doc_id"), "host", "path", "quality_evidence", "toxic_evidence", "p_quality", "p_toxic", "keep")
