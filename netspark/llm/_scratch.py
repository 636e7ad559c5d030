"""Tables in the cluster's shared checkpoint folder, and size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from netspark.session import doomed, shared_folder

#: A join side of at most so many rows of a few numbers is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def root(spark: SparkSession) -> str:
    """Folder for this application's tables: under ``spark.checkpoint.dir``.

    Only where neither that setting nor a checkpoint directory of the context
    exists and the master is local, a temporary one is set.
    """
    return f"{shared_folder(spark)}/netspark-{spark.sparkContext.applicationId}"


def write(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    doomed(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def measured(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """write() and the values of named aggregates over the rows, from the same pass."""
    seen = Observation()
    out = write(df.observe(seen, *metrics), name)
    return out, seen.get


def drop(*tables: DataFrame) -> None:
    """Delete tables that write() made and that no later plan reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small enough, else unchanged."""
    return F.broadcast(df) if fits(df, rows) else df


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id isn't in ids (one column of the same name); null ids stay."""
    gone = hinted(ids.select(F.col(id_col).alias("__netspark_gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["__netspark_gone"], "left_anti")
