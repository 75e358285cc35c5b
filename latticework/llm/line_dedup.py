"""Line dedup: a segment-partition edit join over distinct lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.quality_rules import let
from latticework.llm.shared import components, discarded, small, written

#: Lines at this edit distance or less are the same line.
EDITS = 2
#: Shorter lines (in code points) must be equal: two edits of a few characters make another line.
LEAST_CHARS = 30
#: Equal blocks of so many code points are stripped from both ends before verification.
BLOCK = 16
#: Counts of these characters, modulo 16, go with a line's keys: an edit moves two of them by one at most.
COUNTED = " etaoinrsh"
#: Lines of candidate pairs are picked by a broadcast of their hashes up to so many.
MAX_BROADCAST_IDS = 500_000
#: Numbers of lines to remove are broadcast up to so many, beyond that they meet their texts in a shuffle.
MAX_BROADCAST_LINES = 1_000_000
BLANKS = " \t\n\x0b\x0c\r"


def segment(length: str, i: str) -> tuple[str, str]:
    """SQL for start (from 1) and size of segment i of EDITS + 1 near-even ones; the last ones are longer by one."""
    k = EDITS + 1
    return (
        f"({i} * ({length} div {k}) + greatest(0, {length} % {k} - ({k} - {i})) + 1)",
        f"({length} div {k} + if({k} - {i} <= {length} % {k}, 1, 0))",
    )


def piece(start: str, size: str) -> str:
    """SQL for UTF-8 bytes of code points of ``line``; in a line of ASCII these are found without a search."""
    return f"if(octet_length(line) = n, substring(cast(line as binary), cast({start} as int), cast({size} as int)), cast(substring(line, cast({start} as int), cast({size} as int)) as binary))"


def index_keys(lines: DataFrame) -> DataFrame:
    """src, s, key: a hash of (length, segment number, segment) for each segment of each line."""
    one = lines.select("h", "s", "line", "n", F.expr(f"explode(sequence(0, {EDITS})) as i"))
    return one.select(F.col("h").alias("src"), "s", F.expr(f"xxhash64(n, i, {piece(*segment('n', 'i'))})").alias("key"))


def probe_keys(lines: DataFrame) -> DataFrame:
    """dst, t, key, even: the hashes with which a line asks for lines that are as long (even) or up to EDITS shorter.

    For each shorter length and each of its segments these are the substrings of the segment's size at the places
    where it can stand if the edits ahead of it and behind it leave it whole: at most i places away on the left
    count and EDITS - i on the right count.
    """
    moves = [
        f"({shorter}, {i}, {move})"
        for shorter in range(EDITS + 1)
        for i in range(EDITS + 1)
        for move in range(max(-i, shorter - (EDITS - i)), min(i, shorter + (EDITS - i)) + 1)
    ]
    one = lines.select("h", "s", "line", "n", F.expr(f"explode(array({', '.join(moves)})) as m"))
    one = one.select("h", "s", "line", "n", F.expr("n - m.col1").alias("other"), F.expr("m.col1 = 0").alias("even"), F.expr("m.col2").alias("i"), F.expr("m.col3").alias("move"))
    start, size = segment("other", "i")
    fits = one.where(f"other >= {LEAST_CHARS} and {start} + move >= 1 and {start} + move + {size} - 1 <= n")
    return fits.select(F.col("h").alias("dst"), F.col("s").alias("t"), F.expr(f"xxhash64(other, i, {piece(f'{start} + move', size)})").alias("key"), "even")


def tally(line: Column) -> Column:
    """Counts of the COUNTED characters (of one byte each) modulo 16, four bits each in a long."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return packed


def far_apart(a: str, b: str) -> str:
    """SQL for tallies that EDITS edits cannot lead from one to the other."""
    parts = []
    for k in range(len(COUNTED)):
        d = f"(((shiftrightunsigned({a}, {4 * k}) & 15) - (shiftrightunsigned({b}, {4 * k}) & 15)) & 15)"
        parts.append(f"least({d}, 16 - {d})")
    return f"{' + '.join(parts)} > {2 * EDITS}"


def within_edits(a: Column, b: Column) -> Column:
    """Whether two texts are at most EDITS edits of code points apart, by a banded bit-parallel automaton.

    Bits of a word are the 2 * EDITS + 1 diagonals of the band for each number of edits; a character of b moves all
    of them at once. Equal blocks are stripped from both ends first, which leaves the distance as it is.
    """
    width, unit = 2 * EDITS + 1, 4 * BLOCK
    level = (1 << width) - 1
    every = sum(1 << e * width for e in range(EDITS + 1))
    below = (1 << EDITS * width) - 1
    no_low = sum((level & ~1) << e * width for e in range(EDITS + 1))
    no_high = sum((level >> 1) << e * width for e in range(EDITS + 1))
    first = sum(1 << e * width + EDITS + e for e in range(EDITS + 1))
    whole = (1 << (EDITS + 1) * width) - 1

    def steps(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def spread(r: Column) -> Column:  # a character of a left out: next diagonal, one edit more
        for _ in range(EDITS):
            r = r.bitwiseOR(F.shiftleft(r.bitwiseAND(F.lit(no_high & below)), width + 1))
        return r

    def band(p: Column, t: Column) -> Column:
        rows, n = F.octet_length(p) / 4, (F.octet_length(t) / 4).cast("int")

        def move(r: Column, x: Column) -> Column:
            c = F.substring(t, 4 * x + 1, F.lit(4))
            same = sum((F.when((x + d >= 0) & (F.substring(p, F.greatest(4 * (x + d) + 1, F.lit(1)), F.lit(4)) == c), 1 << d + EDITS).otherwise(0) for d in range(-EDITS, EDITS + 1)), F.lit(0))
            kept = r.bitwiseAND(same * every)
            edited = F.shiftleft(r.bitwiseOR(F.shiftright(r.bitwiseAND(F.lit(no_low)), 1)).bitwiseAND(F.lit(below)), width)
            return F.when(r == 0, 0).otherwise(spread(kept.bitwiseOR(edited)).bitwiseAND(F.lit(whole)))

        end = F.aggregate(steps(n), F.lit(first), move)
        at = (rows - n).cast("int") + EDITS
        return (at >= 0) & (at < width) & (end.bitwiseAND(F.call_function("shiftleft", F.lit(every), F.greatest(at, F.lit(0)))) != 0)

    def strip(s: Column) -> Column:
        p, t = s["p"], s["t"]
        least = F.least(F.octet_length(p), F.octet_length(t))

        def blocks(n: Column, at) -> Column:
            return F.aggregate(steps(n), F.lit(0), lambda k, i: F.when((k == i) & (F.substring(p, at(p, i), F.lit(unit)) == F.substring(t, at(t, i), F.lit(unit))), k + 1).otherwise(k))

        def cut(k: Column) -> Column:
            behind = blocks(F.floor(least / unit).cast("int") - k, lambda x, i: F.octet_length(x) - unit * (i + 1) + 1)
            return let(behind, lambda b: F.struct(*(F.substring(x, unit * k + 1, F.octet_length(x) - unit * (k + b)).alias(c) for x, c in ((p, "p"), (t, "t")))))

        return let(blocks(F.floor(least / unit).cast("int"), lambda x, i: unit * i + 1), cut)

    wide = F.struct(F.encode(a, "UTF-32").alias("p"), F.encode(b, "UTF-32").alias("t"))
    return let(let(wide, strip), lambda m: band(m["p"], m["t"]))


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), line_no, h (hash of the line), line: all lines with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = slim.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.btrim("line", F.lit(BLANKS)) != "").withColumn("h", F.xxhash64("line"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h, line, n (code points), c (places), s (tally; 0 for short lines) of all distinct lines."""
    lines = exploded(docs).groupBy("h", "line").agg(F.count("*").alias("c"))
    return lines.withColumn("n", F.length("line")).withColumn("s", F.when(F.col("n") >= LEAST_CHARS, tally(F.col("line"))).otherwise(F.lit(0).cast("long")))


def line_links(lines: DataFrame) -> DataFrame:
    """Links (src, dst) of different lines of LEAST_CHARS code points or more at EDITS edits or less.

    ``lines`` is a written table of ``distinct_lines``. Lines are known by 64-bit hashes of their text. Each is cut
    into EDITS + 1 segments, one of which every line within reach holds unchanged near its place; substrings of
    matching length and place are probed, and the candidates verified. All keys are compared, none is capped.
    """
    long_ = lines.where(F.col("n") >= LEAST_CHARS)
    index, probe = index_keys(long_), probe_keys(long_)
    pairs = index.join(probe, "key").where(f"src <> dst and (not even or src < dst) and not ({far_apart('s', 't')})").select("src", "dst").distinct()
    pairs = written(pairs, "lines-pairs")
    ids = written(pairs.select(F.col("src").alias("h")).union(pairs.select("dst")).distinct(), "lines-paired")
    texts = written(lines.select("h", "line").join(small(ids, MAX_BROADCAST_IDS), "h", "left_semi"), "lines-texts")
    one, two = texts.select(F.col("h").alias("dst"), F.col("line").alias("b")), texts.select(F.col("h").alias("src"), F.col("line").alias("a"))
    both = pairs.join(one, "dst").join(two, "src")
    return both.where(within_edits(F.col("a"), F.col("b"))).select("src", "dst")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: doc_id, mark, line_no of all but the first place of each class of lines.

    A class is all lines linked by equality or by ``line_links``, over any number of steps. Its first place has the
    smallest doc_id, then line_no. Places of rows that share doc_id and text count as one.
    """
    lines = written(distinct_lines(docs), "lines-distinct")
    links = written(line_links(lines), "lines-links")
    group = components(links, "lines-components").select(F.col("id").alias("h"), "component")
    several = written(lines.where("c > 1").select("h").unionByName(group.select("h")).distinct().join(group, "h", "left").withColumn("cls", F.coalesce("component", "h")).select("h", "cls"), "lines-several")
    classed = written(exploded(docs).select("doc_id", "mark", "line_no", "h").join(small(several, MAX_BROADCAST_IDS), "h").drop("h"), "lines-places")
    first = written(classed.groupBy("cls").agg(F.min(F.struct("doc_id", "line_no", "mark")).alias("first")), "lines-first")
    again = classed.join(small(first, MAX_BROADCAST_IDS), "cls").where("doc_id <> first.doc_id or line_no <> first.line_no or mark <> first.mark")
    return again.select("doc_id", "mark", "line_no")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) without the lines of ``repeated_lines``.

    Returns doc_id, the columns ``keep``, text, n_lines (lines with a word), removed (numbers of removed lines, from 0),
    one row per input row. Lines without a word stay, and a text without repeats is unchanged (null becomes empty).
    Rows without doc_id take no part and stay as they are.
    """
    again = written(repeated_lines(docs).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "lines-removed")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("text")).withColumn("mark", F.xxhash64("text"))
    if (again.agg(F.sum(F.size("removed"))).first()[0] or 0) <= MAX_BROADCAST_LINES:
        again = F.broadcast(again)
    both = slim.join(again, ["doc_id", "mark"], "left")
    left = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: x[i]), "\n"))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")
    return both.select(
        "doc_id", *keep, F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"), lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )
