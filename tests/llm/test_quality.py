import os
import random
import re

import numpy as np
import pytest

from tessera.llm import quality


def corpus(rng, n, clean_words, toxic_words):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean_words) for _ in range(rng.randrange(30, 200))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(toxic_words))
        text = " ".join(words)
        if bad:
            text = " | ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"src{i % 5}", len(text), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = corpus(rng, 900, clean, ["zorkly", "zorkish", "vexbad"])
    known, held = labels[:600], {x[0]: x for x in labels[600:]}
    d = spark.createDataFrame([(*r,) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    lab = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    rows = quality.score(d, lab).collect()
    assert len(rows) == 900
    got = {r.ord: r for r in rows}
    right = [(got[i].p_quality >= 0.5) == (q == 1) for i, q, _ in held.values()]
    assert sum(right) / len(right) > 0.97
    right = [(got[i].p_toxic >= 0.5) == (t == 1) for i, _, t in held.values()]
    assert sum(right) / len(right) > 0.95
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.ord for r in rows if r.keep}


def brute_features(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    n, n_words = len(data) + 1, len(words) + 1
    share = lambda keep: sum(map(keep, data)) / n
    of = lambda chars: share(lambda c: c in chars.encode())
    counts = {w: words.count(w) for w in set(words)}
    return [
        np.log(n), np.log(n_words), share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), of("|"), of("!"), of("#$%&*"), of(".,:;"), of("<>"), share(lambda c: c > 127),
        n / n_words / 10, len(counts) / n_words, sum(a == b for a, b in zip(words, words[1:])) / n_words, max(counts.values(), default=0) / n_words, len(set(lines)) / len(lines), np.log(len(lines)),
        min(max(map(len, counts), default=0), 100) / 50,
    ]


def brute_stems(text):
    out = set()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        out |= {w} | {w[:k] + "*" for k in (4, 5, 6, 7, 8) if k < len(w)}
    return out


def brute_logistic(x, y, ask):
    """Log-odds of ask from a ridge logistic fit on standardized features and squares."""
    m, sd = x.mean(0), x.std(0) + 1e-6

    def design(v):
        z = np.clip((v - m) / sd, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.minimum(z**2, 9)])

    z, w = design(x), np.zeros(1 + 2 * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve(z.T @ np.diag(p * (1 - p)) @ z + np.eye(len(w)), z.T @ (p - y) + w)
    return np.clip(design(ask) @ w, -30, 30)


def brute_shift(odds, docs):
    """Each document's shift: its path's shrunk mean against the prior, as log-odds."""
    p, (hosts, paths) = 1 / (1 + np.exp(-odds)), zip(*[(d[3], f"{d[3]}/{d[2]}") for d in docs])

    def level(keys, parents):
        groups = {}
        for k, v, par in zip(keys, p, parents):
            groups.setdefault(k, ([], par))[0].append(v)
        n, mean = (np.array([f(v) for v, _ in groups.values()], float) for f in (len, np.mean))
        par, total = np.array([x for _, x in groups.values()]), len(p)
        within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v, _ in groups.values())
        k = 1e6
        if total > len(n) and total**2 != (n**2).sum():
            tau = ((n * (mean - par) ** 2).sum() - (len(n) - 1) * within / (total - len(n))) / (total - (n**2).sum() / total)
            k = min(max((par * (1 - par)).mean() / tau - 1 if tau > 1e-9 else 1e6, 1.0), 1e6)
        return [(sum(groups[x][0]) + k * groups[x][1]) / (len(groups[x][0]) + k) for x in keys]

    logit = lambda v: np.log(v / (1 - v))
    return logit(np.array(level(paths, level(hosts, [p.mean()] * len(p))))) - logit(p.mean())


def test_scores_match_brute_force(spark):
    rng = random.Random(9)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    docs, labels = corpus(rng, 260, clean, ["zorkly", "zorkish", "vexbad"])
    docs = [(*d[:2], ["en", "fr"][d[0] % 2], f"src{min(d[0] % 7, 3)}", *d[4:]) for d in docs]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, keep string")
    got = {r.ord: r for r in quality.score(d, spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")).collect()}
    half = {r.doc_id: r.half for r in spark.range(260).selectExpr("id as doc_id", "pmod(xxhash64(id), 2) as half").collect()}
    known, texts = labels[:200], [x[1] for x in docs]
    stems = [brute_stems(t) for t in texts]
    first = [(stems[i], t) for i, _, t in known if not half[i]]
    n_toxic = sum(t for _, t in first)
    n_clean, scores = len(first) - n_toxic, []
    for w in set().union(*(s for s, _ in first)):
        a, b = (sum(w in s for s, t in first if t == kind) + 0.5 for kind in (1, 0))
        score = np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1))
        z = score / np.sqrt(1 / a + 1 / b)
        if a - 0.5 >= 4 and z > 3 and score > 2.5:
            scores.append((w, score))
    lexicon = dict(scores)
    x = []
    for t, s in zip(texts, stems):
        hits, own = [lexicon[w] for w in s if w in lexicon], brute_features(t)
        strong = sum(h > 4 for h in hits)
        x.append([*own, np.log1p(len(hits)), np.log1p(sum(hits)), max(hits, default=0), np.log1p(strong), strong / (1 + own[1]), own[1]])
    x = np.array(x)
    ids, second = [i for i, *_ in known], [i for i, *_ in known if half[i]]
    q = brute_logistic(x[ids, :18], np.array([labels[i][1] for i in ids], float), x[:, :18])
    t = brute_logistic(x[second, 18:], np.array([labels[i][2] for i in second], float), x[:, 18:])
    for name, odds in (("quality", q), ("toxic", t)):
        assert np.allclose([got[i][f"{name}_evidence"] for i in range(260)], odds, atol=1e-5)
        want = 1 / (1 + np.exp(-(odds + brute_shift(odds, docs))))
        assert np.allclose([got[i][f"p_{name}"] for i in range(260)], want, atol=1e-5)
    assert all(r.keep == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in got.values()) and {r.keep for r in got.values()} == {True, False}


def test_rows_without_an_id_are_judged_one_by_one(spark):
    rng = random.Random(7)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = corpus(rng, 600, clean, ["zorkly", "zorkish", "vexbad"])
    bare = [(None if i % 3 else 5_000, *d[1:]) for i, d in enumerate(docs[:60])] + [docs[100]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string"
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs + bare, schema)
    rows = {(r.ord, r.rk): r.keep for r in quality.score(d, lab).collect()}
    kept = sorted(r.text for r in quality.keep_good(d, lab).collect())
    keys = d.select("text", *quality._keys()).collect()
    assert kept == sorted(r.text for r in keys if rows[r.ord, r.rk])
    left = sum(rows[r.ord, r.rk] for r in keys if r.ord in (5_000, -(1 << 63)))
    assert 20 < left < 50


def test_shrinkage_by_hand(spark):
    rows = [(i, "a", "a/en", 2.0 if i % 2 else -1.0, 0.0) for i in range(40)] + [(i, "a", "a/fr", 1.0, 0.0) for i in range(3)] + [(i, "b", "b/en", -3.0 + i % 3, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "ord long, host string, path string, quality double, toxic double")
    got = {(r.host, r.path): r["shift"] for r in quality.shifts(df, "quality").collect()}
    p = {}
    for _, h, path, q, _ in rows:
        p.setdefault((h, path), []).append(1 / (1 + np.exp(-q)))

    def kappa(groups):  # (values, parent mean)
        n = np.array([len(v) for v, _ in groups], float)
        m = np.array([np.mean(v) for v, _ in groups])
        par = np.array([x for _, x in groups])
        within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v, _ in groups)
        tau = ((n * (m - par) ** 2).sum() - (len(n) - 1) * within / (n.sum() - len(n))) / (n.sum() - (n * n).sum() / n.sum())
        return min(max((par * (1 - par)).mean() / tau - 1 if tau > 1e-9 else 1e6, 1.0), 1e6)

    hosts = {h: [x for (hh, _), v in p.items() if hh == h for x in v] for h in "ab"}
    prior = np.mean([x for v in p.values() for x in v])
    k = kappa([(v, prior) for v in hosts.values()])
    mean = {h: (sum(v) + k * prior) / (len(v) + k) for h, v in hosts.items()}
    k2 = kappa([(v, mean[h]) for (h, _), v in p.items()])
    logit = lambda x: np.log(x / (1 - x))
    for (h, path), v in p.items():
        assert got[h, path] == pytest.approx(logit((sum(v) + k2 * mean[h]) / (len(v) + k2)) - logit(prior), abs=1e-9)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(None, None, None, None, None), (1, "", "en", "http://a.b/c/d?x", 0), (1, "", "en", "http://a.b/c/d?x", 0), (2, "x" * 100_000, "en", "a.b", 1), (3, "\n", "fr", "a/b/c", 1)]
    df = spark.createDataFrame(rows, schema)
    got = quality.score(df, labels).collect()
    assert len(got) == 5 and all(r.keep for r in got)
    assert {(r.host, r.path) for r in got} == {("", "/"), ("a.b", "a.b/c//en"), ("a.b", "a.b/en"), ("a", "a/b//fr")}
    assert quality.keep_good(df, labels).count() == 5
    assert quality.score(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == 5


def test_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").join(docs, "doc_id")
    scored = quality.evidence(held, model).join(labels.withColumnsRenamed({"quality": "is_good", "toxic": "is_toxic"}), quality.F.col("ord") == quality.F.col("doc_id")).collect()
    share = lambda rows, test: sum(map(test, rows)) / len(rows)
    assert share([r for r in scored if r.is_good], lambda r: r.quality > 0) > 0.99
    assert share([r for r in scored if not r.is_good], lambda r: r.quality < 0) > 0.97
    assert share([r for r in scored if not r.is_toxic], lambda r: r.toxic < 0) > 0.98
    assert share([r for r in scored if r.is_toxic], lambda r: r.toxic > 0) > 0.75
