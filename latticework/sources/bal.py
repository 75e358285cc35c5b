"""Bundle-adjustment text files (plain or bz2), raw parameter dumps, and Parquet checkpoints of problems.

A text file has a line ``cameras landmarks observations``, a line ``cam pt x y`` for each observation, nine lines for each
camera and three for each landmark. Lines are numbered from the counts of the file's splits and dealt by number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators.relational import dense_index


@dataclass
class Problem:
    obs: DataFrame
    cam: DataFrame
    pt: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, at: the lines of a text file, or of a folder's files by name, numbered from 0; no line goes through Python."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))
    splits = lines.groupBy("file", "start").agg(F.min("m").alias("first"), F.count("*").alias("n"))  # a row for each split
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "start"]).select("line", (F.col("before") + F.col("m") - F.col("first")).alias("at"))


def read(spark: SparkSession, path: str, far: float | None = 1e6) -> Problem:
    """obs(res_id, cam_id, pt_id, x, y), cam(cam_id, p), pt(pt_id, q) of a text file.

    Landmarks with a squared norm beyond ``far`` go with their observations; the rest are numbered anew without gaps,
    as are landmarks no observation names. ``far=None`` keeps all and their numbers.
    """
    lines = numbered_lines(spark, path)
    head = lines.where("at = 0").first().line.split()
    cameras, landmarks, n = map(int, head[:3])
    one = (F.col("at") > 0) & (F.col("at") <= n)
    obs = lines.where(one).select((F.col("at") - 1).alias("res_id"), F.when(one, F.split(F.trim("line"), r"\s+")).alias("w"))  # other lines must not be parsed, wherever the filter is evaluated
    obs = obs.select("res_id", *(F.col("w")[i].cast(k).alias(c) for i, (c, k) in enumerate((("cam_id", "long"), ("pt_id", "long"), ("x", "double"), ("y", "double")))))

    def vectors(first: int, count: int, width: int, key: str, name: str) -> DataFrame:
        mine = (F.col("at") >= first) & (F.col("at") < first + count * width)
        rows = lines.where(mine).select(F.floor((F.col("at") - first) / width).cast("long").alias(key), "at", F.when(mine, F.trim("line").cast("double")).alias("v"))
        packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s"))
        return packed.select(key, F.transform("s", lambda e: e["v"]).alias(name))

    cam, pt = vectors(n + 1, cameras, 9, "cam_id", "p"), vectors(n + 1 + 9 * cameras, landmarks, 3, "pt_id", "q")
    if far is not None:
        near = pt.where(F.expr("aggregate(q, 0D, (a, v) -> a + v * v)") <= far)
        index = dense_index(obs.join(near, "pt_id", "left_semi"), "pt_id", "new")
        obs = obs.join(index, "pt_id").select("res_id", "cam_id", F.col("new").alias("pt_id"), "x", "y")
        pt = near.join(index, "pt_id").select(F.col("new").alias("pt_id"), "q")
    return Problem(obs, cam, pt)


def write(problem: Problem, path: str) -> None:
    """The problem as a folder of text in the same layout, in order; ids must be dense."""
    spark = problem.obs.sparkSession
    sizes = [df.count() for df in (problem.cam, problem.pt, problem.obs)]
    number = lambda c: F.col(c).cast("string")
    parts = [
        spark.range(1).select(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c"), F.lit(" ".join(map(str, sizes))).alias("value")),
        problem.obs.select(F.lit(1), F.col("res_id"), F.lit(0), F.concat_ws(" ", F.col("cam_id").cast("string"), F.col("pt_id").cast("string"), number("x"), number("y"))),
        problem.cam.select(F.lit(2), F.col("cam_id"), F.posexplode("p").alias("c", "v")).select("2", "cam_id", "c", number("v")),
        problem.pt.select(F.lit(3), F.col("pt_id"), F.posexplode("q").alias("c", "v")).select("3", "pt_id", "c", number("v")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    whole.repartitionByRange("a", "b").sortWithinPartitions("a", "b", "c").select("value").write.text(path)


def save(problem: Problem, path: str) -> None:
    """Parquet checkpoint of all three tables."""
    for name in ("obs", "cam", "pt"):
        getattr(problem, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Problem:
    return Problem(*(spark.read.parquet(f"{path}/{name}") for name in ("obs", "cam", "pt")))


def save_parts(obs_part: DataFrame, path: str) -> None:
    """Observations by part, a folder for each."""
    obs_part.write.mode("overwrite").partitionBy("part").parquet(path)


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    """What ``save_parts`` wrote, each observation with its part again."""
    return spark.read.parquet(path)


def from_dump(spark: SparkSession, path: str, width: int, key: str, name: str) -> DataFrame:
    """Rows of ``width`` doubles of a headerless file of float64, numbered by their place. Tasks read splits of whole rows."""
    rows = spark.sparkContext.binaryRecords(path, 8 * width).zipWithIndex()
    return rows.map(lambda r: (r[1], np.frombuffer(r[0], np.float64).tolist())).toDF(f"{key} long, {name} array<double>")
