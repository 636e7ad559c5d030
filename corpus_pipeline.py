"""The corpus pipeline: documents to packed windows in five stages.

Each stage works on all rows that its predecessor kept. Rows with null or empty
texts leave at the first stage; rows with null ids pass through to the last,
which has no piece for them; rows that repeat an id share its fate where
a stage judges ids (near duplicates, decontamination) and are judged by their texts
where it judges texts; of near duplicates the least id stays, also of ties. Very long texts are
worked on whole, and empty tables give no windows. Extra columns of documents, of any
name, pass through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netspark.llm import _scratch, decontaminate, near_dup, packing, quality_rules, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their compression bands; null and empty texts go."""
    return quality_rules.keep_compressible(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows that hold all documents."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", windows)]

#: Compression, the network and online packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        docs = _scratch.write(done, name.replace(" ", "_")) if i < len(STAGES) - 1 else done
    return docs
