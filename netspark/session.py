"""Sessions, tables that cut lineage, and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most so many rows may be broadcast.
BROADCAST_ROWS = 500_000


def session(app: str = "netspark", **conf: str) -> SparkSession:
    """A session with the settings the library expects: UTC, adaptive plans, Arrow."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size allows that, else as it is."""
    return F.broadcast(df) if fits(df, rows) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the context's own; a temporary one only for a local master, since on a cluster executors don't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="netspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def doomed(spark: SparkSession, path: str) -> None:
    """Have the application's folder, of which path is a part, deleted when the driver ends."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)


def measured(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """checkpointed() and the values of named aggregates over its rows, from the same pass."""
    seen = Observation()
    out = checkpointed(df.observe(seen, *metrics))
    return out, seen.get


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, so that iterations don't grow the plan and a lost executor costs no more than one of them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/netspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    doomed(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.checkpoint_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete the files of a checkpointed() table that no later plan reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.checkpoint_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
