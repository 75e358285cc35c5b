"""From raw documents to a training mix: each stage takes what its predecessor kept.

Quality rules drop documents; line dedup drops repeated lines, and documents of which too little is left; near-dedup keeps one document of each group;
decontamination drops documents that hold a test item; mixing says how often each of the rest is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import decontaminate, line_dedup, minhash, mixing, quality_rules, registry
from latticework.llm.shared import WORD, discarded, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The quality rules' least number of words, which documents must keep when they lose lines.
LEAST_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. Rows without a doc_id are judged by their own text; null and empty texts go."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, n_chars counted anew.

    A document that loses lines and has fewer than LEAST_WORDS words left goes; others stay. Null texts become empty, rows
    without a doc_id keep their lines.
    """
    out = line_dedup.remove_repeats(docs, keep=("lang", "source"))
    words = F.regexp_count("text", F.lit(WORD))
    out = out.where((F.size("removed") == 0) | (words >= LEAST_WORDS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, unchanged. Rows without words or without a doc_id are in no group and stay."""
    return minhash.keep_first(docs).select(*COLUMNS)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table benchmark, unchanged. Null and empty texts hold none."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, times, taken. A null text has no words, a null source is a source."""
    return mixing.mix_by_source(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", test_items),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discarded(*before)
        before = [docs]
    return docs


ORACLE_SQL = f"""
with good as (
  with {registry.quality_sql("documents")}
  select d.* from documents d join verdicts using (doc_id) where kept
), lined as materialized (
  with recursive {registry.line_dedup_sql("good")}
  select doc_id, deduped.text, good.source from deduped join good using (doc_id)
  where n_removed = 0 or len(regexp_extract_all(deduped.text, '[^\\x20\\x09-\\x0D]+')) >= {LEAST_WORDS}
), near as ({registry.near_sql("lined")}),
single as materialized (select lined.* from lined join near using (doc_id) where kept),
leaks as ({registry.leak_sql("single")}),
clean as materialized (select * from single where doc_id not in (select doc_id from leaks)),
mixed as (with {registry.mix_sql("clean")} select * from mix)
select doc_id, source, size, source_size, target, times, taken from mixed
"""
