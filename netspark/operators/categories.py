"""Connections between categories of nodes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.errors import ValidationError
from netspark.operators.temporal import TemporalGraphs, extract_temporal_metrics

UNKNOWN = "unknown"


def _categories(metadata: DataFrame, column: str) -> DataFrame:
    if missing := [c for c in ("node_id", column) if c not in metadata.columns]:
        raise ValidationError(f"metadata lack {missing}", field="metadata", value=metadata.columns)
    return metadata.select("node_id", F.col(column).cast("string").alias("c")).dropDuplicates(["node_id"])


def category_connections(edges: DataFrame, metadata: DataFrame, category_column: str, edge_weight: str = "count") -> DataFrame:
    """``date, category_a <= category_b, connection_strength, edge_count`` of ``slice_end, source_id, target_id, weight``; nodes without metadata are ``unknown``."""
    side = _categories(metadata, category_column)
    x = edges.join(side.toDF("source_id", "ca"), "source_id", "left").join(side.toDF("target_id", "cb"), "target_id", "left")
    a, b = F.coalesce("ca", F.lit(UNKNOWN)), F.coalesce("cb", F.lit(UNKNOWN))
    strength = {"count": F.count("*").cast("double"), "sum": F.sum("weight"), "mean": F.avg("weight")}[edge_weight]
    return x.groupBy(F.col("slice_end").alias("date"), F.least(a, b).alias("category_a"), F.greatest(a, b).alias("category_b")).agg(strength.alias("connection_strength"), F.count("*").alias("edge_count"))


def analyze_cross_category_connections(temporal_graphs: TemporalGraphs, metadata: DataFrame, category_column: str, edge_weight: str = "count") -> DataFrame:
    """category_connections() of all slices, in order."""
    if edge_weight not in ("count", "sum", "mean"):
        raise ValueError("edge_weight must be count, sum or mean")
    if not len(temporal_graphs):
        raise ValueError("there are no slices")
    return category_connections(temporal_graphs.edges, metadata, category_column, edge_weight).orderBy("date", "category_a", "category_b")


def calculate_category_segregation_index(category_connections: DataFrame, normalize: bool = True) -> DataFrame:
    """``date, segregation_index, within_category_strength, between_category_strength``; the index is within over all, or within less between if not normalised."""
    if missing := [c for c in ("date", "category_a", "category_b", "connection_strength") if c not in category_connections.columns]:
        raise ValueError(f"columns are missing: {missing}")
    same = F.col("category_a") == F.col("category_b")
    s = F.col("connection_strength")
    g = category_connections.groupBy("date").agg(F.sum(F.when(same, s).otherwise(0.0)).alias("within_category_strength"), F.sum(F.when(~same, s).otherwise(0.0)).alias("between_category_strength"))
    w, b = F.col("within_category_strength"), F.col("between_category_strength")
    index = F.coalesce(F.try_divide(w, w + b), F.lit(0.0)) if normalize else w - b
    return g.select("date", index.alias("segregation_index"), "within_category_strength", "between_category_strength").orderBy("date")


def analyze_category_centrality_by_time(temporal_graphs: TemporalGraphs, metadata: DataFrame, category_column: str, centrality_metric: str = "degree") -> DataFrame:
    """``date, category, mean_centrality, median_centrality, max_centrality, node_count`` of the nodes present in each slice."""
    values = extract_temporal_metrics(temporal_graphs, [centrality_metric]).withColumnRenamed(centrality_metric, "v")
    here = temporal_graphs.edges.select(F.col("slice_end").alias("date"), F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    x = values.join(here, ["node_id", "date"], "left_semi").join(_categories(metadata, category_column), "node_id", "left")
    return x.groupBy("date", F.coalesce("c", F.lit(UNKNOWN)).alias("category")).agg(F.avg("v").alias("mean_centrality"), F.median("v").alias("median_centrality"), F.max("v").alias("max_centrality"), F.count("*").alias("node_count")).orderBy("date", "category")
