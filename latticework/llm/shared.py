"""Materialising, bounded broadcasts and connected components, shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.session import ship

#: White space of every operator here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Texts can be long, so fewer go to Python at once than Spark would send.
BATCH_ROWS = 1500
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves if the executors are threads of the driver; on a cluster it must be set.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="latticework-")
        delete_at_exit(spark, _own_dirs[context.applicationId])
    return _own_dirs[context.applicationId]


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has ``path`` deleted when the driver ends, if it is still there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run here delete their shuffle files when they end."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. codec: Parquet's compression, else the session's.

    Lineage ends there: a lost executor costs its running tasks, not the steps before. Shuffle files of the step go when it
    ends, the table when it is ``discarded`` or the driver ends. Spark sizes the tasks behind shuffles.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_mark(text: Column) -> Column:
    """A 64-bit hash of a text, which with the doc_id tells rows apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` on executors that have this package, in batches of BATCH_ROWS texts at most."""
    spark = df.sparkSession
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Queries that run here send at most ``rows`` rows to Python at once, for rows that hold megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that Spark shuffles it.

    ``df`` should be a written table: it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(src, dst)`` by alternating large and small stars.

    Returns (id, component) for every id on an edge; component is the smallest id reachable.
    Each round is written, nothing is collected but two counts; hubs are spread by joins that
    Spark can split. Self loops and repeated edges are allowed, null ends are ignored.
    """
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("src is not null and dst is not null and a > b").distinct()
    e = written(e, name)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large, name)
        discarded(e)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = written(e, name)
        discarded(large)
        rows, ids = e.agg(F.count("*"), F.count_distinct("a")).first()
        if rows == ids and e.join(e.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():  # stars whose centres are no one's leaf
            break
    roots = e.select(F.col("b").alias("id")).distinct()
    out = written(e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))), name)
    discarded(e)
    return out
