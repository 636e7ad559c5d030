"""Edges from embeddings of posts: features of senders, and similar senders."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.edges import dense_codes
from netspark.errors import ConfigurationError, ValidationError, validate_parameter
from netspark.functions.weights import dimension_weight
from netspark.session import checkpointed, small

log = logging.getLogger("netspark.embed")
#: Rows of a block of vectors that meets all others, and pairs that are measured at once.
BLOCK, AT_ONCE = 16384, 65536
#: By how much a product of unit vectors in single precision may differ from that in double.
SLACK = 2e-5


def encoded(df: DataFrame, post_col: str, to: str, model: Any, batch_size: int = 32) -> DataFrame:
    """df with vectors of an object that has ``encode(list of texts)``, or of a sentence-transformers model by name; loaded once a task."""
    if isinstance(model, str):
        name = model

        def load() -> Any:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as error:
                raise ConfigurationError("a model by name needs the package sentence_transformers", parameter="model", value=name, cause=error) from error
            return SentenceTransformer(name)
    else:
        def load() -> Any:
            return model

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            out: list = []
            for i in range(0, len(texts), batch_size):
                out += np.asarray(encoder.encode(texts.iloc[i : i + batch_size].tolist()), float).tolist()
            yield pd.Series(out)

    from collections.abc import Iterator as It  # the pandas UDF reads its hints

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, "array<double>")(F.col(post_col)))


def _vectors(df: DataFrame, sender_col: str, post_col: str, embedding_col: str | None, model: Any, batch_size: int, datetime_col: str | None) -> DataFrame:
    """``sender, v[, t]`` without nulls; vectors of unequal length are an error."""
    needed = [sender_col, embedding_col or post_col, *([datetime_col] if datetime_col else [])]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValidationError(f"columns are missing: {missing}", field="df", value=df.columns)
    df = df.dropna(subset=[sender_col, embedding_col or post_col])
    if embedding_col is None:
        if model is None:
            raise ConfigurationError("give embedding_col or a model", parameter="model")
        df, embedding_col = encoded(df, post_col, "__v", model, batch_size), "__v"
    if not isinstance(df.schema[embedding_col].dataType, T.ArrayType):
        raise ValidationError("embeddings must be arrays", field=embedding_col, value=df.schema[embedding_col].dataType.simpleString())
    time = [F.col(datetime_col).alias("t")] if datetime_col else []
    return df.select(F.col(sender_col).alias("sender"), F.col(embedding_col).cast("array<double>").alias("v"), *time)


def pooled(vectors: DataFrame, aggregation: str = "mean", normalize: bool = False) -> DataFrame:
    """``sender, dim, w``: vectors (sender, v) pooled by dimension; with normalize each vector first gets length 1."""
    validate_parameter(aggregation, ["mean", "sum", "max"], "aggregation")
    if normalize:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        vectors = vectors.withColumn("n", norm).withColumn("v", F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")))
    how = {"mean": F.avg, "sum": F.sum, "max": F.max}[aggregation]
    return vectors.select("sender", F.posexplode("v").alias("dim", "x")).groupBy("sender", "dim").agg(how("x").alias("w"))


def _checked(vectors: DataFrame) -> DataFrame:
    lo, hi = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if lo is None:
        raise ValidationError("there are no embeddings", field="df")
    if lo != hi:
        raise ValidationError("embeddings differ in length", field="embedding_col", value=(lo, hi))
    return vectors


def _cached(vectors: DataFrame, save_path: str | None, create_new: bool) -> DataFrame:
    """Vectors kept as Parquet under save_path: read if there, unless create_new."""
    if save_path is None:
        return vectors
    spark: SparkSession = vectors.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(save_path)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if create_new or not there:
        vectors.write.mode("overwrite").parquet(save_path)
    out = spark.read.parquet(save_path)
    if there and not create_new and (out.count() != vectors.count()):
        raise ValidationError("the kept embeddings are of other posts; use create_new", field="save_path", value=save_path)
    return out


def extract_embedding_features(df: DataFrame, *, sender_col: str = "sender", post_col: str = "post", embedding_col: str | None = None, datetime_col: str | None = "datetime", feature_col: str = "feature", weight_col: str = "weight", first_seen_col: str = "first_seen", model: Any = None, batch_size: int = 32, show_progress: bool = False, device: str | None = None, normalize_embeddings: bool = True, save_path: str | None = None, create_new: bool = False, aggregate_inline: bool = True, chunk_size: int | None = None, aggregation: str = "mean", weight_transform: str = "shift", shift_amount: float = 2.0, power: float = 0.5, top_k: int | None = None, min_weight: float | None = None, feature_prefix: str = "dim_") -> DataFrame:
    """``sender, feature, weight, first_seen``: senders' pooled vectors as weighted edges to dimensions; after the transform min_weight, then each sender's top_k. Caching, chunks and devices need no care here."""
    validate_parameter(weight_transform, ["shift", "abs", "raw", "power_shift"], "weight_transform")
    vectors = _checked(_cached(_vectors(df, sender_col, post_col, embedding_col, model, batch_size, datetime_col), save_path, create_new))
    x = pooled(vectors, aggregation, normalize_embeddings)
    x = x.select("sender", F.concat(F.lit(feature_prefix), F.col("dim")).alias(feature_col), "dim", dimension_weight(F.col("w"), weight_transform, shift_amount, power).alias(weight_col))
    if min_weight is not None:
        x = x.where(F.col(weight_col) >= min_weight)
    if top_k is not None:
        rank = F.row_number().over(Window.partitionBy("sender").orderBy(F.desc(weight_col), "dim"))
        x = x.withColumn("__r", rank).where(F.col("__r") <= top_k)
    x = x.select(F.col("sender").alias(sender_col), feature_col, weight_col)
    if datetime_col:
        x = x.join(vectors.groupBy(F.col("sender").alias(sender_col)).agg(F.min("t").alias(first_seen_col)), sender_col)
    return x


def nearest(vectors: DataFrame, k: int, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """``id, other, sim``: each unit vector's (id, v) k most similar others, of at least floor; ties by id.

    All pairs are looked at, as blocks of the ids in their order: a task has one block and is sent all
    others, and keeps each vector's k best so far. Products are of single precision; whatever they can't
    tell from the k-th is measured in double, as is all that is given back.
    """
    spark = vectors.sparkSession
    vectors = checkpointed(vectors)
    codes = checkpointed(dense_codes(vectors, "id"))
    n = codes.count()
    size = max(1, min(block, -(-n // (3 * spark.sparkContext.defaultParallelism))))
    parts = max(1, -(-n // size))
    own = vectors.join(small(codes), F.col("id") == F.col("node_id")).groupBy(F.floor(F.col("code") / size).cast("int").alias("b"))
    blocks = checkpointed(own.agg(F.collect_list(F.struct("code", "v")).alias("rows")))
    sent = blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("task", (F.col("b") != F.col("task")).alias("far"), "rows")
    parted = sent.repartitionById(parts, "task").sortWithinPartitions("task", "far")

    def matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = rows.flatten()
        code, v = flat.field("code").to_numpy(), flat.field("v")
        order = np.argsort(code)
        return code[order], v.flatten().to_numpy().reshape(len(code), -1)[order]

    def joined(best: tuple, x: np.ndarray, y: np.ndarray, code: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple:
        """The best of each row (row, other, sim) with new pairs, measured in double some at a time."""
        sim = np.concatenate([np.einsum("ij,ij->i", x[row[i : i + AT_ONCE]], y[col[i : i + AT_ONCE]]) for i in range(0, len(row), AT_ONCE)] or [np.zeros(0)])
        ok = np.ones(len(sim), bool) if floor is None else sim >= floor
        row, other, sim = (np.concatenate([old, new]) for old, new in zip(best, (row[ok], code[col[ok]], sim[ok]), strict=True))
        order = np.lexsort((other, -sim, row))
        row, other, sim = row[order], other[order], sim[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) < k
        return row[keep], other[keep], sim[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = -1, None

        def given() -> pa.RecordBatch:
            row, other, sim = (np.concatenate(c) for c in zip(*best, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(mine[row]), pa.array(other), pa.array(sim)], ["a", "b", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                code, y = matrix(batch["rows"].slice(i, 1))
                if batch["task"][i].as_py() != now:
                    if best is not None:
                        yield given()
                    now, (mine, x) = batch["task"][i].as_py(), (code, y)
                    low, best = x.astype(np.float32), [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))] * -(-len(x) // 512)
                short = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.float32)
                short[: len(y)] = y
                same = mine is code
                for r in range(0, len(x), 512):
                    sims = low[r : r + 512] @ short.T
                    sims[:, len(y) :] = -np.inf
                    if same:
                        sims[np.arange(len(sims)), np.arange(r, r + len(sims))] = -np.inf
                    groups = sims.reshape(len(sims), -1, 64)
                    most = groups.max(axis=2)
                    # The k-th of groups' largest is no more than the k-th of all; so is the k-th that a row has.
                    least = np.partition(most, -k, axis=1)[:, -k] if most.shape[1] >= k else np.full(len(sims), -np.inf, np.float32)
                    known = best[r // 512]
                    count = np.bincount(known[0] - r, minlength=len(sims))
                    worst = np.full(len(sims), np.inf)
                    np.minimum.at(worst, known[0] - r, known[2])
                    least = np.maximum(np.maximum(least, np.where(count >= k, worst, -np.inf)), -np.inf if floor is None else floor) - SLACK
                    at, group = np.nonzero((most >= least[:, None]) & (most > -np.inf))
                    hit, lane = np.nonzero((groups[at, group] >= least[at, None]) & (groups[at, group] > -np.inf))
                    row, col = at[hit], group[hit] * 64 + lane
                    for j in range(0, len(row), 16 * AT_ONCE):
                        part = slice(j, j + 16 * AT_ONCE)
                        best[r // 512] = joined(best[r // 512], x, y, code, row[part] + r, col[part])
        if best is not None:
            yield given()

    near = parted.mapInArrow(run, "a long, b long, sim double")
    out = near.join(small(codes).toDF("id", "a"), "a").join(small(codes).toDF("other", "b"), "b")
    return out.select("id", "other", "sim")


def extract_embedding_similarity_edgelist(df: DataFrame, *, sender_col: str = "sender", post_col: str = "post", embedding_col: str | None = None, datetime_col: str | None = None, source_col: str = "source", target_col: str = "target", weight_col: str = "weight", model: Any = None, batch_size: int = 32, show_progress: bool = False, device: str | None = None, normalize_embeddings: bool = True, save_path: str | None = None, create_new: bool = False, aggregate_inline: bool = True, chunk_size: int | None = None, aggregation: str = "mean", metric: str = "cosine", k: int = 30, similarity_threshold: float = 0.0, mutual: bool = False, weight_transform: str = "raw", shift_amount: float = 2.0, power: float = 0.5, n_jobs: int = 1, verbose: bool = True) -> DataFrame:
    """``source < target, weight``: senders whose pooled vectors are among each other's k nearest by cosine (one way, or both ways if mutual), of at least the threshold."""
    validate_parameter(metric, ["cosine"], "metric")
    validate_parameter(weight_transform, ["shift", "abs", "raw", "power_shift"], "weight_transform")
    if k < 1:
        raise ConfigurationError("k must be positive", parameter="k", value=k)
    vectors = _checked(_cached(_vectors(df, sender_col, post_col, embedding_col, model, batch_size, None), save_path, create_new))
    long = pooled(vectors, aggregation, normalize_embeddings)
    one = long.groupBy("sender").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "w"))), lambda s: s["w"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = one.withColumn("n", norm).select(F.col("sender").alias("id"), F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.col("v")).alias("v"))
    near = nearest(unit, k, similarity_threshold)
    pairs = near.groupBy(F.least("id", "other").alias(source_col), F.greatest("id", "other").alias(target_col)).agg(F.count("*").alias("__c"), F.max("sim").alias(weight_col))
    if mutual:
        pairs = pairs.where("__c = 2")
    return pairs.select(source_col, target_col, dimension_weight(F.col(weight_col), weight_transform, shift_amount, power).alias(weight_col))
