import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_lines
import test_quality
import test_shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    made, labels = test_quality.corpus(rng, 120, words, ["zorkly", "vexbad"])
    docs = [(i, "\n".join(t[k : k + 90] for k in range(0, len(t), 90)), lang, src, n) for i, t, lang, src, n, _ in made]
    copies = [(1000 + k, docs[k][1], "en", "src9", 5) for k in range(30)]
    near = [(2000 + k, docs[k][1].replace(docs[k][1].split()[3], "changed", 1), "en", "src9", 5) for k in range(30)]
    # Rows that share or lack a doc_id; each is judged and kept for itself.
    good = [i for i, q, t in labels if q and not t]
    more = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bare = [(None, f"{docs[g][1]}\n{more(12)}", "en", "src1", 5) for g in good[40:46]]
    bare += [(4000, "\n".join(more(14) for _ in range(6)), "en", "src1", 5) for _ in range(5)]
    docs += copies + near + bare + [(3000, None, None, None, None), (3001, "", "en", "x", 0), (3002, "\n", "en", "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, stages = spark.createDataFrame(docs, schema), []
    for _, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialize(stage(spark, kept, str(tmp_path)), "test")
        stages.append(kept)
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in stages[:-1])
    rows = lambda df: sorted(map(tuple, df.selectExpr("*", "xxhash64(doc_id, text) as h").collect()), key=str)
    first, second, third = map(rows, stages[:-1])
    assert not Counter(r[:5] for r in first) - Counter(docs)
    ids, bad = {r[0] for r in first}, {i for i, q, t in labels if not q or t}
    assert len(set(range(120)) - bad - ids) <= 5 and len(bad & ids) <= 10
    assert sum(r[0] is None for r in first) >= 3 and sum(r[0] == 4000 for r in first) >= 3
    want = test_lines.brute([r[:4] for r in first], 2, 24, [r[5] for r in first])
    want = [r for r in want if not ((r[5] or r[6]) and not (r[1] or "").strip())]
    assert sorted((r[:4] for r in second), key=str) == sorted((r[:4] for r in want), key=str)
    sets, label = [test_shingles.brute_set(r[1]) for r in second], list(range(len(second)))
    for i in range(len(second)):
        for j in range(i):
            if label[i] != label[j] and test_shingles.similar(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = [min((r for r, x in zip(second, label) if x == own), key=lambda r: (r[0] is None, r[0] or 0, r[5])) for own in set(label)]
    assert third == sorted(least, key=str) and len(third) < len(second)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed, bins = [tuple(r) for r in stages[-1].collect()], defaultdict(int)
    expected = []
    for i, text, *_ in third:
        token_ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(token_ids), 2048):
            part = token_ids[k : k + 2048]
            expected.append((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((p[:5] for p in packed), key=str) == sorted(expected, key=str)
    for p in packed:
        bins[p[5]] += p[3]
    assert max(bins.values()) <= 2048
    assert sorted((r[:5] for r in map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())), key=str) == sorted(expected, key=str)
