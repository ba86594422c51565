import hashlib
import unittest.mock as mock

import public_tokenizers
import tiktoken

from tessera.llm import bytebpe

TEXTS = ["", None, " ", "\n\n  a", "The quick  brown fox'll don't 12345 <|endoftext|>", "é ü 中文字 👍🏽 x\x1c", "supercalifragilisticexpialidocious " * 3, "a" * 300, "same text", "same text", "\ttab \r\n end \n"] + [f"word{i} unusualle{i % 7}tion" for i in range(60)]


def reference():
    ranks = bytebpe.read_ranks(public_tokenizers.path(bytebpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_library(spark):
    lib = reference()
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    want = sorted((i // 2, lib.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
    by_spark = bytebpe.encoded_by_spark(df)
    assert sorted((r.doc_id, list(r.ids)) for r in by_spark.collect()) == want
    ids = bytebpe.encoded(df)
    assert sorted((r.doc_id, list(r.ids)) for r in ids.collect()) == want
    assert sorted(bytes(r.bytes) for r in bytebpe.decoded(ids).collect()) == sorted((t or "").encode() for t in TEXTS)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(tuple(r) for r in bytebpe.digests(df).collect())
    assert got == sorted((i, len(x), sha(" ".join(map(str, x)).encode()), sha(lib.decode_bytes(x))) for i, x in want)
    assert bytebpe.digests(df.limit(0)).count() == 0


def test_numbering_starts_anew_over_many_batches():
    import pyarrow as pa

    with mock.patch.object(bytebpe, "MOST_WORDS", 3):
        batches = [pa.record_batch([pa.array([i]), pa.array([f"a{i} b c d b"])], names=["doc_id", "text"]) for i in range(4)]
        rows = [r for b in bytebpe._split_stream(public_tokenizers.PATTERN)(iter(batches)) for r in b.to_pylist()]
    assert all(r["starts"] for r in rows) and all(len(r["words"]) == 5 for r in rows)
    feed = [pa.RecordBatch.from_pylist([{**r, "ids": [[len(w)] for w in r["words"]]}]) for r in rows]
    assert [(d, w) for d, w in bytebpe._assemble(iter(feed), [], list)] == [(i, [[1], [1], [2], [2], [2], [2]]) for i in range(4)]


def test_long_and_short_words_merge_alike():
    import random

    lib, rng = reference(), random.Random(5)
    ranks = bytebpe.read_ranks(public_tokenizers.path(bytebpe.RANKS))
    for n in (1, 2, 5, 30, 47, 48, 49, 50, 200, 3000):
        for alphabet in ("a", "abcdefghijklmnopqrst", "etaoin shrd"):
            word = "".join(rng.choice(alphabet.replace(" ", "")) for _ in range(n)).encode()
            assert bytebpe.merged(word, ranks) == lib._core_bpe.encode_single_piece(word)


def test_a_full_memo_of_words_is_kept_beside_the_next():
    ranks, real, seen = public_tokenizers.path(bytebpe.RANKS), bytebpe.merged, []
    made = bytebpe.text_encoder(ranks, public_tokenizers.PATTERN, "digest")
    own = bytebpe.TextEncoder(ranks, public_tokenizers.PATTERN, made.per_word, made.joined, most=3)
    with mock.patch.object(bytebpe, "merged", lambda word, ranks: seen.append(word) or real(word, ranks)):
        got = own("aqx bqx, cqx dqx aqx eqx aqx fqx, aqx")
    assert seen.count(b" aqx") == 1 and len(got) == 9 and len(own.words) <= 3
    lib = reference()
    ids = lib.encode_ordinary("aqx bqx, cqx dqx aqx eqx aqx fqx, aqx")
    assert " ".join(c[1] for c in got) == " ".join(map(str, ids)) and b"".join(c[2] for c in got) == lib.decode_bytes(ids) and sum(c[0] for c in got) == len(ids)
