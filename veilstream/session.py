"""Session helpers: shipping the package to executors and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, once per SparkContext, so that workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_veilstream_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="veilstream-", suffix=".zip")
    with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("veilstream", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._veilstream_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='veilstream-shared-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilstream/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Unlike a local checkpoint this survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders that materialise has written, by application.
_written: dict[str, list[str]] = {}


def cleanup(spark: SparkSession) -> int:
    """Delete, by name, the folders that this driver's operators have written, and return how many. Call it when the results that read them are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
