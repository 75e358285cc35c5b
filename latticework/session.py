"""What a Spark session needs before Python functions of this package run on its executors, and where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
#: Seconds between two collections of the driver's garbage.
CLEANED_EVERY = 10.0
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="latticework-")) / "latticework_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


_own_dirs: dict[str, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder of ``spark.checkpoint.dir`` and read back; lineage and plan end there.

    Where that is unset a local folder serves if the executors are the driver's threads. Tables go when the driver ends. Unlike
    a checkpoint a table brings no inferred constraints along, which would make plans of long loops ever slower.
    """
    spark = df.sparkSession
    sc, shared = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not shared and sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="latticework-")
    path = f"{(shared or _own_dirs[sc.applicationId]).rstrip('/')}/latticework/kept-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}
_last_cleaned = 0.0


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``kept`` wrote, which no later query reads; other tables stay.

    Shuffle files go when the driver collects its garbage, which in a long loop of small queries it hardly does by itself, so it is asked to.
    """
    global _last_cleaned
    for df in tables:
        if path := _paths.pop(id(df), None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables and time.monotonic() - _last_cleaned > CLEANED_EVERY:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
        _last_cleaned = time.monotonic()
