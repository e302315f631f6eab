"""Session helpers: shared scratch space, lineage cuts, worker imports, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` if the session has it. Where it is unset: a temporary folder
    in local mode, which has one machine, else a folder inside the warehouse.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="orbis-"))
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
        return f"file://{_LOCAL_SCRATCH[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_orbis_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked_broadcast(df: DataFrame, n_rows: int, most: int = 500_000) -> DataFrame:
    """Hint a broadcast only while the counted rows stay under ``most``; else a shuffled join."""
    return F.broadcast(df) if n_rows <= most else df


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't on their path yet."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([x for x in [root, env.get("PYTHONPATH", "")] if x])
