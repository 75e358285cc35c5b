"""Quality rules with thresholds from quantile sketches of each language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.shared import SPACE, small, text_mark, written

#: Size of a sketch: exact up to about so many rows of a group, rank error far below a percent beyond.
SKETCH_K = 4096
#: A group's thresholds are averaged with its language's as if that had so many rows, a language's with those of the whole.
PRIOR_ROWS = 200.0
#: Fences lie so many quartile ranges outside the quartiles.
REACH = 4.0
#: Statistics of a document: (least spread used for the fence, has a lower fence too).
STATS = {"mean_chars": (0.5, True), "symbol_share": (0.02, False), "dup_share": (0.08, False), "repeat_share": (0.08, False), "upper_share": (0.05, False)}
#: Thresholds of at most so many groups are broadcast.
MAX_BROADCAST_GROUPS = 100_000


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in 3-word windows that the text holds twice or more, the first ones included.

    Windows are sorted by a 64-bit hash with their place; equal neighbours mark the places, whose gaps give the count.
    """

    def places(s: Column) -> Column:
        return F.array_sort(
            F.filter(
                F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])),
                lambda p: p.isNotNull(),
            )
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(p, i - 1), F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def windows(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")))
        return F.when(F.size(w) >= 4, let(F.array_sort(keys), lambda s: let(places(s), covered))).otherwise(0)

    return windows(words)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts and shares of every whole text (null: no words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    one = base.select(
        "doc_id", "lang", "source", counts.alias("c"), by_line.alias("l"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[A-Z]+", ""))).cast("long").alias("n_upper"),
    ).select("doc_id", "lang", "source", "c.*", "l.*", "n_symbols", "n_upper")
    some = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return one.withColumns({
        "mean_chars": F.col("word_chars") / some, "symbol_share": F.col("n_symbols") / chars, "dup_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / some, "upper_share": F.col("n_upper") / chars,
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def thresholds(stats: DataFrame) -> DataFrame:
    """Fences of each (lang, source): lang, source, lo_<stat>, hi_<stat>.

    Each group is one sketch for each statistic; sketches of a language's sources merge into the language's, those into one.
    A fence is the mean of the group's own, weighed by its rows, and its language's, weighed as PRIOR_ROWS; that of a
    language is averaged with the whole's alike. So a fence follows its group as that grows, without a step.
    """
    names = list(STATS)
    groups = written(stats.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in names)), "quality-sketches")

    def merged(*by: str) -> DataFrame:
        merge = [F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in names]
        return groups.groupBy(*by).agg(F.sum("n").alias("n"), *merge)

    def fences(df: DataFrame, *by: str) -> DataFrame:
        cut = []
        for c, (least, low) in STATS.items():
            q1, q3 = (F.kll_sketch_get_quantile_double(c, F.lit(q)) for q in (0.25, 0.75))
            spread = REACH * F.greatest(q3 - q1, F.lit(least))
            cut += [(q1 - spread if low else F.lit(-1e308)).alias(f"lo_{c}"), (q3 + spread).alias(f"hi_{c}")]
        return df.select(*by, F.struct("n", *cut).alias("f"))

    own, by_lang, whole = fences(groups, "lang", "source"), fences(merged("lang"), "lang"), fences(merged().where("n > 0"))
    by_lang = by_lang.select(F.col("lang").alias("lang2"), F.col("f").alias("g"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang2")), "left").crossJoin(F.broadcast(whole.select(F.col("f").alias("h"))))  # one row

    def mean(of: str, upper: Column, c: str) -> Column:
        share = F.col(f"{of}.n") / (F.col(f"{of}.n") + F.lit(PRIOR_ROWS))
        return share * F.col(f"{of}.{c}") + (F.lit(1.0) - share) * upper

    names = [f"{e}_{c}" for c in STATS for e in ("lo", "hi")]
    return written(joined.select("lang", "source", *(mean("f", mean("g", F.col(f"h.{c}"), c), c).alias(c) for c in names)), "quality-thresholds")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document, one row per input row.

    ``docs`` needs doc_id, text, lang and source; other columns are ignored. kept is false for fewer than 50 words,
    for more than half of the words in repeated 3-word windows, and for a statistic outside its group's fences
    (quartiles of the group +- REACH ranges, see ``thresholds``). Null and empty texts have no words and fail. Null lang or source is
    a group of its own.
    """
    stats = written(document_stats(docs), "quality-stats")
    cuts = small(thresholds(stats).withColumnsRenamed({"lang": "lang_", "source": "source_"}), MAX_BROADCAST_GROUPS)
    inside = F.lit(True)
    for c in STATS:
        inside = inside & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    out = stats.join(cuts, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that ``quality_verdicts`` keeps, with all their columns.

    A row is judged by its own text, lang and source: rows that share a doc_id, or have none, may part.
    """
    marked = docs.withColumn("__row_mark", F.xxhash64(text_mark(F.col("text")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.isnull("lang"), F.isnull("source")))
    judged = quality_verdicts(marked.select(F.col("__row_mark").alias("doc_id"), "text", "lang", "source"))
    good = written(judged.where("kept").select(F.col("doc_id").alias("__row_mark")).distinct(), "quality-kept")
    return marked.join(small(good, 500_000), "__row_mark", "left_semi").select(*docs.columns)
