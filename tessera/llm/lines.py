"""Line dedup by a segment-partition edit join, in built-in functions only.

A line is dropped if an equal line, or one within ``max_edits`` edits of it, comes
before it; lines are ordered by (doc_id, position). Equal lines are first put
together by a 128-bit hash, with partial aggregation, and each distinct line then
stands for its first occurrence.

Edit join. A line is cut into max_edits + 1 segments; of two lines within max_edits
edits, one segment is untouched in both. Segment lengths depend on a class of line
lengths (the length's leading bits), so lines of one class, and those a few
characters into the next, meet in one index. The first and the last segment are
anchored at the line's ends and are their own probe; a middle segment is probed at
each shift that edits on its shorter side allow. Hashes of (class, segment number,
substring) are the index; groups of a hash that hold a single line are left at once.
Pairs are formed where lengths and letter counts allow the edits, and verified by
a banded bit-parallel edit distance (Hyyro, 2003): the 2 max_edits + 1 cells of a
column around the diagonal are one machine word.

None of these tables has a bound, so their joins are sort-merge joins at every size.
A hash that many lines share, as with templates and passages that begin many lines, gives
no pairs at once: its lines are dealt by length, what all of them share is cut off, and
what is left of them is cut into segments again, until groups are small (``near_lines``).
A line needs one earlier neighbour only and leaves as soon as it has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_bitmap, materialize, read_table, row_keys, scratch

#: Letters whose counts are compared before two lines are; any other count as one.
LETTERS = tuple("etaoinsrhldcumfpgwybvk .,")
#: What tells lines apart: the keys of their row, and their place in it.
AT = ("ord", "rk", "pos")


def _lines(docs: DataFrame) -> DataFrame:
    """(ord, rk, pos, line): the lines of every document that are not blank, trimmed."""
    keyed = docs.select(*row_keys(), "text")
    split = keyed.select("ord", "rk", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return split.select(*AT, F.btrim("raw", F.lit(" \t\r")).alias("line")).where("line <> ''")


def _hash(salt: int, text: Column) -> Column:
    return F.xxhash64(F.lit(salt), text)


def length_class(n: Column) -> Column:
    """The least length of n's class: n with all but its three leading bits cleared,
    in steps of 8 at least."""
    step = F.greatest(F.lit(8), F.pow(F.lit(2), F.floor(F.log2(n + 0.5)) - 2).cast("int"))
    return (n - n % step).cast("int")


def segments(n: Column, least: Column, max_edits: int) -> list[tuple[int, Column, Column, bool]]:
    """(number, place from 1, length, only a probe) of each segment and shift of a text of
    n characters among texts of least characters or a few more."""
    k = F.floor(least / (max_edits + 1)).cast("int")
    out = []
    for i in range(max_edits + 1):
        back = max_edits - i  # segments behind it
        from_start = i <= back
        reach = min(i, back)
        for shift in sorted(range(-reach, reach + 1), key=abs):
            at = k * i + 1 + shift if from_start else n - k * (back + 1) + 1 + shift
            out.append((i, at.cast("int"), k, shift != 0))
    return out


def _slots(n: Column, max_edits: int) -> list[tuple[Column, int, Column, Column, bool]]:
    """(class, number, place, length, only a probe) of the segments of a line of n
    characters in its own class, then in the class that partners below may be in."""
    own, below = length_class(n), length_class(n - max_edits)
    return [(least, *x) for least in (own, below) for x in segments(n, least, max_edits)]


def _keys(line: Column, n: Column, max_edits: int, min_chars: int) -> Column:
    """The hashes of a line's segments by slot; those of the class below only where a
    partner may be there."""
    keys = [F.xxhash64(least, F.lit(i), F.substring(line, at, k)) for least, i, at, k, _ in _slots(n, max_edits)]
    crossing = (length_class(n - max_edits) < length_class(n)) & (n - max_edits >= min_chars)
    none = F.array().cast("array<bigint>")
    return F.when(n < min_chars, none).when(crossing, F.array(*keys)).otherwise(F.array(*keys[: len(keys) // 2]))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value worked out once for a body that uses it often; in a lambda, any other
    expression would be worked out again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two texts of lengths that differ by max_edits at most are within
    max_edits edits, by code points.

    Bit i of a column's word is the cell of row j - max_edits + i. vp and vn hold
    where a cell of the last column is one more or one less than the cell above,
    already moved to the next column's band; rows above the matrix match anything
    and rise from its corner. dist follows the diagonal that ends in the last cell.
    """
    width = 2 * max_edits + 1
    full = (1 << width) - 1
    n, m = F.length(a), F.length(b)

    def column(x: Column, s: Column, j: Column, letter: Column, at: Column) -> Column:
        """s: the state before column j (from 0); at: the bit of the diagonal that
        ends in the last cell."""
        eq = F.lit(0).cast("long")
        for i in range(width):
            row = j + (i - max_edits)
            # Rows above the text lie outside: they count as matches, so that the edge stays a plain border.
            hit = F.when(row < 0, True).otherwise(F.coalesce(F.get(x, F.greatest(row, F.lit(0))) == letter, F.lit(False)))
            eq = eq.bitwiseOR(F.when(hit, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))

        def with_eq(e: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (e.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def with_d0(d: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
                hn = d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                nvp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full)))
                nvn = down.bitwiseAND(hp)
                stay = F.call_function("shiftright", d, at).bitwiseAND(F.lit(1))
                return F.struct(nvp.bitwiseAND(F.lit(full)).alias("vp"), nvn.alias("vn"), (s["dist"] + 1 - stay).alias("dist"))

            return _let(d0, with_d0)

        return _let(eq, with_eq)

    # The diagonal through the last cell (row n, column m) is bit n - m + max_edits.
    # It starts at row n - m of column 0, whose distance is |n - m|.
    at = n - m + max_edits
    start = F.struct(
        F.lit(full - (1 << max_edits) + 1).cast("long").alias("vp"),
        F.lit((1 << max_edits) - 1).cast("long").alias("vn"),
        F.abs(n - m).cast("long").alias("dist"),
    )
    columns = F.transform(F.split(b, ""), lambda c, j: F.struct(c.alias("c"), j.alias("j")))
    shift = F.struct(F.split(a, "").alias("x"), at.alias("at"))
    step = lambda h, s, c: F.when(s["dist"] > max_edits, s).otherwise(column(h["x"], s, c["j"], c["c"], h["at"]))
    walked = _let(shift, lambda h: F.aggregate(columns, start, lambda s, c: step(h, s, c), lambda s: s["dist"]))
    return F.when(m == 0, n <= max_edits).otherwise(walked <= max_edits)


def share_segments(a: Column, b: Column, max_edits: int, parts: int = 12) -> Column:
    """Whether all but max_edits of so many segments of a stand in b, moved by
    max_edits characters at most: so it is for any two texts within max_edits edits."""
    k = F.floor(F.length(a) / parts).cast("int")
    found = F.lit(0)
    for i in range(parts):
        at = k * i + 1
        begin = F.greatest(at - max_edits, F.lit(1))
        near = F.substring(b, begin, k + (at - begin) + max_edits)
        found = found + F.contains(near, F.substring(a, at, k)).cast("int")
    return found >= parts - max_edits


def distinct_lines(docs: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """(h1, h2, n, keys, times, ord, rk, pos) of each distinct line; the last three are
    those of its first occurrence, by _order."""
    n = F.length("line")
    # One number to be compared: ord, 31 bits of pos, 31 bits of rk.
    low = F.shiftleft(F.col("pos").cast("long"), 31) + F.pmod("rk", F.lit(1 << 31))
    place = (F.col("ord").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)")).cast("decimal(38,0)") + low.cast("decimal(19,0)")
    rows = _lines(docs).select(
        _hash(1, F.col("line")).alias("h1"), _hash(2, F.col("line")).alias("h2"), n.alias("n"), _keys(F.col("line"), n, max_edits, min_chars).alias("keys"), "rk", place.cast("decimal(38,0)").alias("place")
    )
    found = rows.groupBy("h1", "h2", "n", "keys").agg(F.min("place").alias("first"), F.min_by("rk", "place").alias("rk"), F.count("*").alias("times"))
    low = F.pmod(F.col("first"), F.lit(1 << 62).cast("decimal(38,0)"))
    ord_ = ((F.col("first") - low) / F.lit(1 << 62).cast("decimal(19,0)")).cast("long")
    return found.select("h1", "h2", "n", "keys", "times", ord_.alias("ord"), "rk", F.shiftright(low.cast("long"), 31).cast("int").alias("pos"))


def _common(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""

    def count(x: Column) -> Column:
        def with_y(y: Column) -> Column:
            most = F.least(F.size(x), F.size(y))
            unlike = F.filter(F.sequence(F.lit(0), most), lambda i: (i >= most) | (F.get(x, i) != F.get(y, i)))
            return F.array_min(unlike).cast("int")

        return _let(F.split(b, ""), with_y)

    return F.when((a == "") | (b == ""), F.lit(0)).otherwise(_let(F.split(a, ""), count))


def _near(a_line: Column, b_line: Column, max_edits: int) -> Column:
    return share_segments(a_line, b_line, max_edits) & within_edits(a_line, b_line, max_edits)


def _hits(pairs: DataFrame, max_edits: int) -> DataFrame:
    """AT of the later ones of (a_line, b_line, AT of b) pairs that are near."""
    return pairs.where(_near(F.col("a_line"), F.col("b_line"), max_edits)).select(*AT).distinct()


def _apart(a: Column, b: Column) -> Column:
    """How far two counts of letters differ; an edit changes those of two by one."""
    return sum((F.abs(a[i] - b[i]) for i in range(1, len(LETTERS))), F.abs(a[0] - b[0]))


def _order(side: str = "") -> Column:
    """What lines are ordered by; it may be compared and its least taken."""
    rk = F.col(f"{side}rk")
    return F.struct(F.col(f"{side}ord").alias("ord"), F.col(f"{side}pos").alias("pos"), F.pmod(rk, F.lit(1 << 31)).alias("r"), rk.alias("rk"))


def _open(rows: DataFrame, hits: DataFrame | None) -> DataFrame:
    """The rows of lines that have no near neighbour yet."""
    return rows if hits is None else rows.join(hits.hint("merge"), list(AT), "left_anti")


def _joined(hits: DataFrame | None, found: DataFrame) -> DataFrame:
    return found if hits is None else hits.unionByName(found).distinct()


def near_lines(docs: DataFrame, distinct: DataFrame, max_edits: int, min_chars: int, group_rows: int) -> DataFrame:
    """(ord, rk, pos) of the first occurrence of each distinct line that an earlier line is
    within max_edits edits of.

    Lines that share a segment's hash are a group. In every group each line is first
    compared with the group's first; those that are near are settled and no longer sought
    partners for. Groups of up to group_rows then form their other pairs. Larger
    ones are dealt anew: first by length, a line to its own and as the longer one to the
    lengths below; then the shared segment goes, beginnings and ends that all have are cut
    off, and the rest is segmented again. Two lines that are near on both sides of their
    segment are no farther apart without it, so no pair is lost; pairs are verified on
    lines, not on what is left of them. The rest shrinks each time, and of max_edits
    characters or fewer it has few values, so this ends.
    """
    probes = F.array(*[F.lit(x[-1]) for x in _slots(F.lit(0), max_edits)])
    rows = distinct.where(F.size("keys") > 0).select(*AT, "n", F.posexplode("keys").alias("slot", "key"))
    who = F.xxhash64(*AT)
    groups = rows.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("key")
    groups = materialize(groups, "line-groups")
    shared = in_bitmap(rows, F.col("key"), groups, F.col("key")).join(groups.hint("merge"), "key")
    shared = materialize(shared.select("key", *AT, "n", "slot"), "line-keys")

    # Texts of the lines that share a key, from the documents that have any.
    wanted = shared.select(*AT).distinct()
    some = in_bitmap(docs.select("doc_id", "text"), F.xxhash64(*row_keys()), wanted, F.xxhash64("ord", "rk"))
    line = F.col("line")
    counts = [(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("short") for c in LETTERS]
    texts = _lines(some).join(wanted.hint("merge"), list(AT), "left_semi").dropDuplicates(list(AT)).select(*AT, "line", F.array(*counts).alias("letters"))
    slots = _slots(F.col("n"), max_edits)
    cut = lambda part: F.get(F.array(*[x[part] for x in slots]), F.col("slot"))
    level = shared.join(texts.hint("merge"), list(AT)).select(
        "key", *AT, "n", "line", "letters", F.get(probes, F.col("slot")).alias("probe"), F.lit(False).alias("later"),
        _without(line, cut(2), cut(3)).alias("rest"),
    )
    level, hits, depth = materialize(level, "line-level"), None, 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, rest = ~F.col("later"), F.col("rest")
    while True:
        ends = [] if not depth else [F.min(rest).alias("a"), F.max(rest).alias("z"), F.min(F.reverse(rest)).alias("ra"), F.max(F.reverse(rest)).alias("rz")]
        groups = level.groupBy("key").agg(
            F.min(who).alias("lo"), F.max(who).alias("hi"), F.count("*").alias("size"), F.min(F.when(own, F.struct(_order().alias("at"), "line", "letters"))).alias("first"),
            F.max(F.when(own, F.length(rest))).alias("least"), *ends,
        ).where("lo <> hi and first is not null")
        if depth:
            groups = groups.withColumn("head", F.when(F.col("size") <= group_rows, F.lit(0)).otherwise(F.least(_common(F.col("a"), F.col("z")), F.col("least"))))
            groups = groups.withColumn("tail", F.when(F.col("size") <= group_rows, F.lit(0)).otherwise(F.least(_common(F.col("ra"), F.col("rz")), F.col("least") - F.col("head"))))
        groups = groups.drop("lo", "hi", "a", "z", "ra", "rz")
        # Few bytes, much work: not to be put together in fewer tasks.
        level = level.join(materialize(groups, "line-groups").hint("merge"), "key")
        level = materialize(level.repartition(parts, "key"), "line-level")

        behind = level.where((F.col("first.at") < _order()) & (F.abs(F.length("line") - F.length("first.line")) <= max_edits))
        behind = behind.where(_apart(F.col("letters"), F.col("first.letters")) <= 2 * max_edits)
        behind = _open(behind, hits).select(F.col("first.line").alias("a_line"), F.col("line").alias("b_line"), *AT)
        hits = materialize(_joined(hits, _hits(behind, max_edits)), "line-hits")

        small = F.col("size") <= group_rows
        if depth:
            small |= F.col("least") - F.col("head") - F.col("tail") <= max_edits
        a = level.where(small).drop("first")
        b = _open(a, hits).alias("b")
        met = (
            (F.col("a.key") == F.col("b.key")) & (_order("a.") < _order("b.")) & (F.abs(F.col("a.n") - F.col("b.n")) <= max_edits)
            & ~(F.col("a.probe") & F.col("b.probe")) & ~(F.col("a.later") & F.col("b.later")) & (_apart(F.col("a.letters"), F.col("b.letters")) <= 2 * max_edits)
        )
        pairs = a.repartition(parts, "key").alias("a").join(b.repartition(parts, F.col("b.key")).hint("merge"), met).select(F.xxhash64(*[f"a.{c}" for c in AT]).alias("a_at"), F.col("a.line").alias("a_line"), F.col("b.line").alias("b_line"), *[f"b.{c}" for c in AT])
        pairs = pairs.dropDuplicates(["a_at", *AT]).repartition(parts, "a_at")
        hits = materialize(_joined(hits, _hits(pairs, max_edits)), "line-hits")

        large = level.where(~small)
        if large.isEmpty():
            return hits
        if not depth:  # by length
            lengths = F.array(*[F.col("n") - d for d in range(max_edits + 1)])
            level = large.select("key", *AT, "n", "line", "letters", "probe", "rest", F.posexplode(lengths).alias("d", "length"))
            level = level.select(F.xxhash64("key", "length").alias("key"), *AT, "n", "line", "letters", "probe", (F.col("d") > 0).alias("later"), "rest")
        else:
            cut_off = F.substring("rest", F.col("head") + 1, F.length("rest") - F.col("head") - F.col("tail"))
            large = large.withColumn("left", (F.col("least") - F.col("head") - F.col("tail")).cast("int")).withColumn("rest", cut_off)
            pieces = segments(F.length("rest"), F.col("left"), max_edits)
            each = F.array(*[F.struct(F.xxhash64("key", F.lit(i), F.substring("rest", at, k)).alias("key"), F.lit(p).alias("probe"), at.alias("at"), k.alias("k")) for i, at, k, p in pieces])
            level = large.select("key", *AT, "n", "line", "letters", "later", "rest", "left").withColumn("part", F.explode(each))
            level = level.select("part.key", *AT, "n", "line", "letters", "part.probe", "later", _without(F.col("rest"), F.col("part.at"), F.col("part.k")).alias("rest"))
        level, depth = materialize(level, "line-level"), depth + 1


def _without(text: Column, at: Column, k: Column) -> Column:
    """The text without the k characters from place at."""
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + k, F.length(text)))


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 24, group_rows: int = 1000) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of text; adds n_lines,
    n_repeated and n_near.

    Lines are parted at line feeds and compared without blanks at their ends; blank
    lines are never dropped. Lines of fewer than min_chars characters, in which
    max_edits edits can make another word or number, are dropped only when equal to an
    earlier one. Null texts stay null with no lines; documents stay even when every
    line has gone. Rows with a null doc_id come first; rows that share or lack a doc_id
    are each documents of their own, in the order of a hash where places are equal. Rows
    equal in doc_id and text are one document twice and lose the same lines. The added
    columns replace any of their names.
    """
    if max_edits not in (1, 2):
        raise ValueError("max_edits is 1 or 2")
    with scratch(docs.sparkSession, "lines-dropped"):
        distinct = materialize(distinct_lines(docs, max_edits, min_chars), "lines")
        near = materialize(near_lines(docs, distinct, max_edits, min_chars, group_rows), "lines-near")
        occurrences = _lines(docs).select(*AT, _hash(1, F.col("line")).alias("h1"), _hash(2, F.col("line")).alias("h2"))
        first = distinct.where("times > 1").select("h1", "h2", *[F.col(c).alias(f"first_{c}") for c in AT])
        repeated = occurrences.join(first.hint("merge"), ["h1", "h2"]).where("ord <> first_ord or rk <> first_rk or pos <> first_pos").select(*AT, F.lit(False).alias("near"))
        # Copies of a line that is near an earlier one are repeated, not near.
        dropped = (
            repeated.unionByName(near.withColumn("near", F.lit(True)))
            .groupBy("ord", "rk")
            .agg(F.collect_set(F.when(~F.col("near"), F.col("pos"))).alias("repeated_at"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near_at"))
        )
        dropped = materialize(dropped, "lines-dropped")
    added = ("n_lines", "n_repeated", "n_near")
    rows = docs.drop(*added)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    zero = F.lit(0).cast("long")
    row, member = F.xxhash64(*row_keys()), F.xxhash64("ord", "rk")
    spared = in_bitmap(rows, row, dropped, member, keep=False)
    spared = spared.withColumns({"n_lines": n_lines, "n_repeated": zero, "n_near": zero})
    ord_, rk = row_keys()
    hit = in_bitmap(rows, row, dropped, member).withColumns({"__ord": ord_, "__rk": rk})
    hit = hit.join(dropped.withColumnsRenamed({"ord": "__ord", "rk": "__rk"}).hint("merge"), ["__ord", "__rk"], "left")
    none = F.array().cast("array<int>")
    gone = F.concat(F.coalesce("repeated_at", none), F.coalesce("near_at", none))

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.size(gone) == 0, F.col("text")).otherwise(_let(F.split("text", "\n"), rest))
    count = lambda c: F.size(F.coalesce(c, none)).cast("long")
    hit = hit.withColumns({"n_lines": n_lines, "n_repeated": count("repeated_at"), "n_near": count("near_at")}).withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(text))
    return spared.unionByName(hit.select(spared.columns))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_repeated, n_near, n_chars, text_sha256 of what is left."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_repeated", "n_near", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
