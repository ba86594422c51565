import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a", "don't you're we'll 'r 've I'", "  two  spaces \n\n and\ttabs \r\n end  ", "x<|endoftext|>y <|endoftext|>  z<|endo", "!!<|endoftext|>", "é ü ß ñ 中文字 日本 　 wide \xa0nbsp", "12345 3.14 a1b2", "\x1cctl\x1d x", "՘֋ odd ꟎", "👍🏽 ok 👨‍👩‍👧", "aaaa" * 50, "'", " '", "'ll", "x'", " 're", "\n'll go", "a \n b", "end\n", "é combining ́"]


def test_counts_and_prefixes_match_the_library():
    lib, own = Tokenizer.from_file(PATH), token_counts.PrefixCounter(PATH, memo=50)
    rng = random.Random(4)
    bits = ["the", "Th", "'re", "'", "ll", " ", "  ", "\n", "\t", "é", "中", "<|", "endoftext", "|>", "!", "1", "ing", "　"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(12)) for _ in range(300)]
    for t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert own.count(t) == n, t
        table = own.prefix_table(t)
        want = [len(lib.encode(t[:j], add_special_tokens=False).ids) for j in range(len(t) + 1)]
        assert table == want, (t, table, want)
        for limit in (0, 1, 3):
            assert own.fitting(t, limit) == max(j for j, x in enumerate(want) if x <= limit)


def test_table(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [*ODD, None, "word " * 60, "x" * 200, "same", "same", "some words, then a longwordwithoutanyblank and more " * 4]
    df = spark.createDataFrame([(i // 2, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    for limit in (7, 33):
        want = []
        for i, t in enumerate(texts):
            t = t or ""
            n = count(t)
            fit = max(j for j in range(len(t) + 1) if count(t[:j]) <= limit) if n > limit else len(t)
            want.append((i // 2, len(t.encode()), n, n > limit, fit))
        assert sorted(tuple(r) for r in token_counts.count_tokens(df, limit=limit).collect()) == sorted(want)
    assert token_counts.count_tokens(df.limit(0)).count() == 0
    assert [r.counts[0] for r in token_counts.prefix_tables(df.limit(3)).collect()] == [0, 0, 0]


def test_long_texts(spark):
    lib = Tokenizer.from_file(PATH)
    for text in ("word " * 3000, "x" * 5000, "é" * 3000, " " * 4000 + "end"):
        row = token_counts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
        count = lambda j: len(lib.encode(text[:j], add_special_tokens=False).ids)  # noqa: E731, B023
        assert row.n_tokens == count(len(text)) and count(row.fit_chars) <= 1024
        assert row.fit_chars == len(text) or count(row.fit_chars + 1) > 1024


def test_plain_words_are_parted_without_the_library(monkeypatch):
    lib, own, rng = Tokenizer.from_file(PATH), token_counts.PrefixCounter(PATH, memo=60), random.Random(6)
    monkeypatch.setattr(token_counts.bpe, "MOST_HEADS", 5)
    monkeypatch.setattr(token_counts.bpe, "MOST_PAIRS", 50)
    syllables = ["the", "on", "ti", "ä", "ß", "É", "zu", "Ch", "x", "ñó", "eit", "ing"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "?!", ")", ".)"]) for _ in range(30)) for _ in range(40)]
    split, seen = own._split, []
    own._split = lambda part: seen.append(part) or split(part)
    assert [own.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts] and not seen
    odd = ["it's", "don't", "x1", "(a", "aª", "aµb", "a×b", "aÿ", "word.'s", "no.1", "a,b", "á", "Ā", "a<|endoftext|>."]
    assert [own.count(t) for t in odd] == [len(lib.encode(t, add_special_tokens=False).ids) for t in odd] and seen


def test_a_full_memo_is_kept_beside_the_next():
    made = []
    memo = token_counts.ChunkMemo(lambda chunk: made.append(chunk) or len(chunk), 3, twice=True)
    assert [memo.plain[x] for x in ("a", "b", "c", "d", "a", "e", "a", "f", "a")] == [1] * 9
    assert made == ["a", "b", "c", "d", "e", "f"] and len(memo.plain) <= 3
