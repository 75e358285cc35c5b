"""Relational operators on observation graphs: obs(res_id?, cam_id, pt_id, x, y), cam(cam_id, ...), pt(pt_id, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.session import kept

#: Ranges of ids that are ranked apart when ids become dense.
RANGES = 4096
#: Consecutive ids that are ranked together within a part.
RUN = 10_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that Spark shuffles it.

    It is counted here, so ``df`` should be a checkpoint, a table, or a cheap view of one.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_index(ids: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct integer ids numbered 0, 1, ... in their order.

    Ids fall in equal ranges between the least and the largest; a range's first number is the count of ids below it,
    so ranges are ranked apart from each other and no task sorts all ids. Nulls are dropped.
    """
    one = ids.select(F.col(column).cast("long").alias(column)).where(F.col(column).isNotNull()).distinct()
    ends = one.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    placed = one.crossJoin(F.broadcast(ends)).select(column, F.expr(f"cast(floor((cast({column} as double) - lo) / ((cast(hi as double) - lo + 1) / {RANGES}D)) as int)").alias("r"))  # ends: one row
    below = placed.groupBy("r").agg(F.count("*").alias("n"))  # at most RANGES rows
    below = below.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy(column)) - 1
    return placed.join(F.broadcast(below), "r").select(column, (F.col("below") + inside).cast("long").alias(name))


def reindex(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with a dense number for each id."""
    return rows.join(dense_index(rows, column, name), column)


def local_reindex(rows: DataFrame, part: str, column: str, name: str) -> DataFrame:
    """Distinct (part, column) with the id's number within its part. Rows with a null in either are dropped.

    Runs of RUN ids that follow each other are ranked apart, so that no task sorts a whole part.
    """
    one = rows.select(part, column).where(F.col(part).isNotNull()).distinct()
    placed = one.join(dense_index(one, column, "run"), column).withColumn("run", F.expr(f"run div {RUN}"))
    below = placed.groupBy(part, "run").agg(F.count("*").alias("n"))
    below = below.select(part, "run", F.coalesce(F.sum("n").over(Window.partitionBy(part).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.row_number().over(Window.partitionBy(part, "run").orderBy(column)) - 1
    return placed.join(below, [part, "run"]).select(part, column, (F.col("below") + inside).cast("long").alias(name))


def places_within(rows: DataFrame, part: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their number, from 1, within their part in the order of ``order``, nulls first; equal rows in any order.

    One sort by range over all parts; what a task has of each part is counted and added up over tasks, so no task sorts or
    holds a part, however large. A null part is a part.
    """
    keys = [F.col(c).asc_nulls_first() for c in (part, *order)]
    at = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    runs = at.groupBy(F.col(part).alias("own"), F.shiftright("at", 33).alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("own").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task that has some of the part
    runs = kept(runs.select("own", "task", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")))
    placed = at.withColumn("task", F.shiftright("at", 33)).join(bounded(runs, RUN).withColumnRenamed("task", "run"), (F.col("task") == F.col("run")) & F.col(part).eqNullSafe(F.col("own")))
    return placed.withColumn(name, F.col("at") + F.col("shift")).drop("at", "task", "run", "own", "shift")


def drop_far(obs: DataFrame, pt: DataFrame, coordinates: Sequence[str], limit: float = 1e6) -> tuple[DataFrame, DataFrame]:
    """Landmarks with a squared norm up to ``limit``, and the observations of landmarks that are not beyond it."""
    norm = sum((F.col(c) * F.col(c) for c in coordinates[1:]), F.col(coordinates[0]) * F.col(coordinates[0]))
    far = pt.where(norm > limit).select("pt_id")
    return obs.join(far, "pt_id", "left_anti"), pt.where(~(norm > limit))


def gather(obs: DataFrame, cam: DataFrame, pt: DataFrame) -> DataFrame:
    """Each observation with the parameters of its camera and landmark."""
    return obs.join(cam, "cam_id").join(pt, "pt_id")


def scatter(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``old`` with the values of ``new``, nulls too, where it has the key."""
    renamed = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("in_new"))
    rest = [c for c in old.columns if c not in columns and c != key]
    return old.join(renamed, key, "left").select(key, *rest, *(F.when(F.col("in_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def range_parts(ids: DataFrame, column: str, parts: int) -> DataFrame:
    """(column, part): the distinct ids in order, dealt to ``parts`` contiguous ranges; the first n % parts get one more."""
    at = dense_index(ids, column, "i")
    n = at.agg(F.count("*").alias("n"))
    small, more = f"(n div {parts})", f"(n % {parts})"
    part = F.expr(f"cast(case when i < {more} * ({small} + 1) then i div ({small} + 1) else {more} + (i - {more} * ({small} + 1)) div nullif({small}, 0) end as int)")
    return at.crossJoin(F.broadcast(n)).select(column, part.alias("part"))  # n: one row


def best_of(rows: DataFrame, by: Sequence[str], value: str, cost: Column, ties: Sequence[str]) -> DataFrame:
    """For each group the ``value`` of least cost, ties by the columns in their order."""
    return rows.groupBy(*by).agg(F.min_by(F.col(value), F.struct(cost, *ties)).alias(value))


def update_parts(res_part: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows (cam_id, pt_id, part) with the part of ``moves`` (cam_id, pt_id, part) where it has the pair; repeated pairs all move."""
    new = moves.select("cam_id", "pt_id", F.col("part").alias("new_part"))
    return res_part.join(new, ["cam_id", "pt_id"], "left").withColumn("part", F.coalesce("new_part", "part")).drop("new_part")
