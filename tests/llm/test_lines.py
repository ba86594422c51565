import random
from collections import Counter

from tessera.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0 or i >= len(s):
            s.insert(i, rng.choice("abcéñ中"))
        elif kind == 1:
            del s[i]
        else:
            s[i] = rng.choice("abcéñ中")
    return "".join(s)


def test_bit_parallel_distance(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("ab中") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30, 90])))
        rows.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2):
        near = df.where(f"abs(length(a) - length(b)) <= {k}")
        got = near.select("a", "b", lines.within_edits(near.a, near.b, k).alias("w"), lines.share_segments(near.a, near.b, k).alias("s")).collect()
        assert all(r.s for r in got if r.w)
        assert got and all(r.w == (distance(r.a, r.b) <= k) for r in got), [(r, distance(r.a, r.b)) for r in got if r.w != (distance(r.a, r.b) <= k)][:5]


def brute(rows, k, least, hashes=None):
    """hashes: of each row's doc_id and text, where rows share a doc_id."""
    keys = [(-(1 << 63) if r[0] is None else r[0], (h % (1 << 31), h)) for r, h in zip(rows, hashes or [0] * len(rows))]
    order = sorted({(d, i, h, ln.strip(" \t\r")) for (d, h), r in zip(keys, rows) if r[1] is not None for i, ln in enumerate(r[1].split("\n"))})
    first, near = {}, set()
    for d, i, h, ln in order:
        if ln:
            first.setdefault(ln, (d, i, h))
    distinct = [ln for ln in first if len(ln) >= least]
    letters = {ln: Counter(ln) for ln in distinct}
    for j, ln in enumerate(distinct):
        for other in distinct[:j]:
            if abs(len(ln) - len(other)) <= k and (letters[ln] - letters[other]).total() <= k and distance(ln, other) <= k:
                near.add(ln)
                break
    out = []
    for (d, t, *rest), (o, h) in zip(rows, keys):
        if t is None:
            out.append((d, None, *rest, 0, 0, 0))
            continue
        keep, rep, nr = [], 0, 0
        for i, raw in enumerate(t.split("\n")):
            ln = raw.strip(" \t\r")
            if ln and first[ln] != (o, i, h):
                rep += 1
            elif ln in near:
                nr += 1
            else:
                keep.append(raw)
        out.append((d, "\n".join(keep), *rest, len(t.split("\n")), rep, nr))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh é中") for _ in range(rng.choice([3, 10, 23, 24, 25, 26, 31, 32, 33, 60, 64, 65, 66, 100, 130]))) for _ in range(60)]
    shared = "".join(rng.choice("abcdefgh ") for _ in range(60))
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(12)):
            s = rng.choice(base)
            own.append(rng.choice([s, s, edited(rng, s, 1), edited(rng, s, 2), edited(rng, s, 3), "", "  " + s + "\r", shared + s[:30], s[:30] + shared]))
        rows.append((d * 3 % 61, "\n".join(own), "en", 1))
    rows += [(None, base[0] + "\nown line of a null id, long enough", "x", 2), (70, None, "x", 3), (71, "", "x", 4), (72, "\n\n", "x", 5), (73, "a" * 400 + "\n" + "a" * 401 + "\n" + "a" * 399, "x", 6)]
    # Rows that share or lack a doc_id are documents of their own.
    rows += [(None, f"unique to row {k} without an id, surely\n{base[k]}", "x", 7) for k in range(6)] + [(None, None, "x", 8), (None, "", "x", 8)]
    rows += [(7, f"{base[k]}\nonly in copy {'abcdef'[k] * 9} of document seven", "x", 9) for k in range(6)] + [(8, "twice the same row, all of it\nindeed", "x", 9)] * 2
    # A template, so that many lines share segments.
    rows += [(100 + d, "\n".join(f"Invoice number {rng.randrange(40) * rng.choice([1, 100, 2500]):08d} was issued on day {rng.randrange(3)}" for _ in range(6)), "x", 9) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, pos int")
    hashes = [r[0] for r in df.selectExpr("xxhash64(doc_id, text)").collect()]
    columns = ("doc_id", "text", "pos", "n_lines", "n_repeated", "n_near")
    want = brute([(r[0], r[1], r[3]) for r in rows], 2, 24, hashes)
    for group_rows in (1000, 3):
        got = lines.dedup_lines(df, group_rows=group_rows).select(*columns).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert sorted(map(tuple, lines.dedup_lines(df, max_edits=1).select(*columns).collect()), key=str) == brute([(r[0], r[1], r[3]) for r in rows], 1, 24, hashes)


def test_lines_that_occur_once_stay(spark):
    rows = [(None, "header line\nunique to A"), (None, "unique to B\nheader line"), (7, "only first\nx"), (7, "x\nonly second")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = Counter(ln for r in got for ln in r.text.split("\n"))
    assert left == Counter(["header line", "unique to A", "unique to B", "only first", "only second", "x"])


def test_templates_are_not_quadratic(spark):
    """Pairs that share two segments would be 4.5 million here."""
    text = [(d, "\n".join(f"Order {(d * 100 + k) * 7919 % 1000003:07d} of the warehouse has left the yard" for k in range(100))) for d in range(30)]
    got = lines.dedup_lines(spark.createDataFrame(text, "doc_id long, text string")).collect()
    order = [ln for d, t in text for ln in t.split("\n")]
    seen, want, digits = set(), Counter(), lambda ln: ln[6:13]
    for d, ln in ((d, ln) for d, t in text for ln in t.split("\n")):
        x = digits(ln)
        masked = {x[:i] + "?" + x[i + 1 : j] + "?" + x[j + 1 :] for i in range(7) for j in range(i + 1, 7)}
        shifted = {x[:i] + x[i + 1 :] for i in range(7)}
        if masked & seen or any(s in seen for s in shifted):
            want[d] += 1
        seen |= masked | shifted
    assert len(order) == len(set(order)) and {r.doc_id: r.n_near for r in got} == {d: want[d] for d, _ in text}
