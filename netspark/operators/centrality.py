"""Centralities of nodes."""

from __future__ import annotations

import logging
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.edges import EdgeList, IDMapper, as_frame
from netspark.errors import ValidationError
from netspark.operators.factor import KERNEL_ROWS, Factor
from netspark.operators.meets import degrees
from netspark.session import checkpointed, fits, measured, released

log = logging.getLogger("netspark.centrality")
METRICS = ["degree", "in_degree", "out_degree", "betweenness", "closeness", "eigenvector", "pagerank", "katz"]


def _nodes(frame: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        nodes = frame.select(F.col("source_id").alias("node_id")).union(frame.select("target_id"))
    return nodes.select("node_id").distinct()


def _degree(frame: DataFrame, metric: str, directed: bool, nodes: DataFrame) -> DataFrame:
    ends = frame.select(F.col("target_id" if metric == "in_degree" else "source_id").alias("node_id"))
    if metric == "degree" or not directed:
        ends = frame.select(F.explode(F.array("source_id", "target_id")).alias("node_id")) if not directed or metric == "degree" else ends
    counts = ends.groupBy("node_id").agg(F.count("*").cast("double").alias("value"))
    return nodes.join(counts, "node_id", "left").select("node_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _symmetric(frame: DataFrame, directed: bool) -> DataFrame:
    """``a, b, w``: arcs, both ways if undirected (loops once)."""
    out = frame.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w"))
    return out if directed else out.union(out.where("a <> b").select("b", "a", "w"))


#: Up to so many arcs and nodes one numpy kernel on the driver iterates; beyond, Spark joins do. Both test convergence after every round.
KERNEL_ARCS = 2_000_000


def power_iteration(frame: DataFrame | EdgeList, nodes: DataFrame, step: str, directed: bool = False, iterations: int = 100, tol: float = 1e-8, damping: float = 0.85, katz_alpha: float | None = None, restart: DataFrame | None = None, total_change: bool = False) -> DataFrame:
    """``node_id, value`` of PageRank, eigenvector or Katz centrality by joins.

    A round is one join along the arcs and one aggregation, whose table is
    written, which cuts the plan; the same pass measures the change (the largest, or the
    sum of all), the weight on nodes without out-arcs and the norm. restart (node_id, s)
    is where PageRank starts and returns to, by default all nodes alike. A graph with a
    factor takes the place of frame, its codes that of ids; rounds go along the factor.
    """
    factor = Factor(frame.factor) if isinstance(frame, EdgeList) else None
    arcs = factor.total().select(F.col("node").alias("a"), F.lit(1.0).alias("w")) if factor else _symmetric(frame, directed).groupBy("a", "b").agg(F.sum("w").alias("w"))
    if step == "pagerank" and not factor:
        arcs = checkpointed(arcs)
        total = arcs.groupBy("a").agg(F.sum("w").alias("t"))
        arcs = arcs.join(total, "a").where("t > 0").select("a", "b", (F.col("w") / F.col("t")).alias("w"))
    arcs = arcs if factor else checkpointed(arcs)
    nodes = nodes.select("node_id").distinct().join(arcs.select(F.col("a").alias("node_id"), F.lit(False).alias("ends")).distinct(), "node_id", "left").select("node_id", F.coalesce("ends", F.lit(True)).alias("ends"))
    if restart is not None:
        nodes = nodes.join(restart.select("node_id", "s"), "node_id", "left").select("node_id", "ends", F.coalesce("s", F.lit(0.0)).alias("s"))
    nodes, seen = measured(nodes, F.count("*").alias("n"))
    n = seen["n"]
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("value"))
    if restart is None:
        nodes = nodes.withColumn("s", F.lit(1.0 / n))
    value = {"pagerank": F.col("s"), "eigenvector": F.lit(1.0 / n**0.5), "katz": F.lit(0.0)}[step]
    if step == "katz" and katz_alpha is None:
        into = degrees(frame.factor, frame.number_of_nodes()) if factor else arcs.groupBy("b").agg(F.count("*").alias("d"))
        most = into.agg(F.max("d")).first()[0] or 0
        katz_alpha = 1.0 / (most + 1)
    if n <= KERNEL_ARCS and (factor.n <= min(KERNEL_ARCS, KERNEL_ROWS) if factor else fits(arcs, KERNEL_ARCS)):
        return _power_kernel(factor or arcs, nodes.select("node_id", "ends", "s", value.alias("value")), step, iterations, tol, damping, katz_alpha, total_change)
    x, seen = measured(nodes.withColumn("value", value), F.sum(F.when(F.col("ends"), F.col("value"))).alias("lost"))
    lost, written = seen["lost"] or 0.0, x
    moved = F.abs(F.col("value") - F.col("was"))
    moved = F.sum(moved) if total_change else F.max(moved)
    for _ in range(iterations):
        if factor:
            from_ = x.join(factor.total(), F.col("node_id") == F.col("node")) if step == "pagerank" else x
            got = factor.times(from_, "node_id", [F.col("value") / F.col("t") if step == "pagerank" else F.col("value")]).withColumnRenamed("m0", "m")
        else:
            got = x.join(arcs, F.col("node_id") == F.col("a")).groupBy(F.col("b").alias("to")).agg(F.sum(F.col("value") * F.col("w")).alias("m"))
        m = F.coalesce("m", F.lit(0.0))
        value = (1 - damping) * F.col("s") + damping * (m + lost * F.col("s")) if step == "pagerank" else 1.0 + katz_alpha * m if step == "katz" else m
        y = x.withColumnRenamed("value", "was").join(got, F.col("node_id") == F.col("to"), "left").select("node_id", "ends", "s", "was", value.alias("value"))
        then, seen = measured(y, moved.alias("change"), F.sum(F.when(F.col("ends"), F.col("value"))).alias("lost"), F.sum(F.col("value") * F.col("value")).alias("square"))
        released(written)
        x, written, lost, change = then, then, seen["lost"] or 0.0, seen["change"]
        if step == "eigenvector":
            norm = seen["square"] ** 0.5 or 1.0
            x = then.withColumn("value", F.col("value") / norm)
            change = x.agg(moved).first()[0]
        x = x.drop("was")
        if change < tol:
            break
    if not factor:
        released(arcs)
    return x.select("node_id", "value")


def _power_kernel(arcs: DataFrame | Factor, nodes: DataFrame, step: str, iterations: int, tol: float, damping: float, katz_alpha: float | None, total_change: bool) -> DataFrame:
    """The same rounds on one machine."""
    if isinstance(arcs, Factor):
        own = nodes.orderBy("node_id").toArrow()
        times = arcs.kernel(own["node_id"].to_numpy())
        out = times(np.ones(own.num_rows)) if step == "pagerank" else np.ones(own.num_rows)
        sums = lambda x: times(np.divide(x, out, out=np.zeros_like(x), where=out > 0))
    else:
        table, own = arcs.toArrow(), nodes.toArrow()
        at = [pc.index_in(table[c].combine_chunks(), value_set=own["node_id"].combine_chunks()).to_numpy(zero_copy_only=False) for c in "ab"]
        w = table["w"].to_numpy()
        known = ~(np.isnan(at[0].astype(float)) | np.isnan(at[1].astype(float)))
        a, b, w = at[0][known].astype(np.int64), at[1][known].astype(np.int64), w[known]
        sums = lambda x: np.bincount(b, weights=x[a] * w, minlength=len(x))
    ends, s, x = own["ends"].to_numpy(zero_copy_only=False).astype(bool), own["s"].to_numpy(), own["value"].to_numpy()
    for _ in range(iterations):
        m = sums(x)
        if step == "pagerank":
            new = (1 - damping) * s + damping * (m + x[ends].sum() * s)
        else:
            new = 1.0 + katz_alpha * m if step == "katz" else m / (np.sqrt((m * m).sum()) or 1.0)
        moved, x = np.abs(new - x), new
        if (moved.sum() if total_change else moved.max()) < tol:
            break
    out = pa.table({"node_id": own["node_id"], "value": pa.array(x)})
    if not isinstance(arcs, Factor):
        released(arcs)
    return nodes.sparkSession.createDataFrame(out, T.StructType([nodes.schema["node_id"], T.StructField("value", T.DoubleType())]))


#: Least sources whose shortest paths one task follows, and edges of a graph that each task may hold.
SOURCES, PATH_EDGES = 64, 5_000_000


def shortest_path_sums(frame: DataFrame, nodes: DataFrame, directed: bool, metric: str) -> DataFrame:
    """``node_id, value``: Brandes' betweenness, or harmonic closeness, over unweighted shortest paths.

    Sources are spread over tasks; each task holds the adjacency once (up to
    PATH_EDGES arcs, since any exact algorithm needs all of it for each source)
    and follows its sources breadth first in numpy.
    """
    arcs = frame.where("source_id <> target_id").select("source_id", "target_id").distinct()
    rows = arcs.limit(PATH_EDGES + 1).toArrow()
    if rows.num_rows > PATH_EDGES:
        raise ValidationError(f"{metric} takes up to {PATH_EDGES} edges", field="graph")
    if not fits(nodes, 2 * PATH_EDGES):
        raise ValidationError(f"{metric} takes up to {2 * PATH_EDGES} nodes", field="graph")
    ids = [r[0] for r in nodes.orderBy("node_id").collect()]
    index = {x: i for i, x in enumerate(ids)}
    a = np.fromiter((index[x] for x in rows["source_id"].to_pylist()), np.int64, rows.num_rows)
    b = np.fromiter((index[x] for x in rows["target_id"].to_pylist()), np.int64, rows.num_rows)
    if not directed:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    n = len(ids)
    start = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    spark = frame.sparkSession
    sent = spark.sparkContext.broadcast((start, pairs[:, 1].copy()))

    def follow(batches: Any) -> Any:
        import pandas as pd

        start, to = sent.value
        total = np.zeros(n)
        for batch in batches:
            for s in batch["id"].to_numpy():
                distance, paths = np.full(n, -1), np.zeros(n)
                distance[s], paths[s] = 0, 1.0
                levels, front, d = [], np.array([s]), 0
                while len(front):
                    count = start[front + 1] - start[front]
                    tail = np.repeat(front, count)
                    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    head = to[start[tail] + offset]
                    d += 1
                    distance[head[distance[head] < 0]] = d
                    on = distance[head] == d
                    tail, head = tail[on], head[on]
                    np.add.at(paths, head, paths[tail])
                    levels.append((tail, head))
                    front = np.unique(head)
                if metric == "closeness":
                    count = np.bincount(distance[distance > 0])  # summed by distance, so that equal nodes get equal values
                    total[s] += (count[1:] / np.arange(1, len(count))).sum()
                else:
                    share = np.zeros(n)
                    for tail, head in reversed(levels):
                        np.add.at(share, tail, paths[tail] / paths[head] * (1 + share[head]))
                    share[s] = 0
                    total += share
        some = np.flatnonzero(total)
        yield pd.DataFrame({"code": some, "value": total[some]})

    # A task adds up all its sources, and tasks are as many as the cluster runs some times over, so that n values a task stay few.
    parts = max(1, min(-(-n // SOURCES), 4 * spark.sparkContext.defaultParallelism))
    out = spark.range(0, n, 1, parts).mapInPandas(follow, "code long, value double").groupBy("code").agg(F.sum("value").alias("value"))
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "code long, node_id " + nodes.schema["node_id"].dataType.simpleString())
    half = 0.5 if metric == "betweenness" and not directed else 1.0
    return names.join(out, "code", "left").select("node_id", (F.coalesce("value", F.lit(0.0)) * half).alias("value"))


def centrality(frame: DataFrame | EdgeList, metric: str, nodes: DataFrame | None = None, directed: bool = False, normalized: bool = True) -> DataFrame:
    """``node_id, value`` of one metric over ``source_id, target_id, weight``.

    Normalised: degrees over n - 1 (directed total over 2 (n - 1)), betweenness
    over pairs, harmonic closeness over n - 1, PageRank scaled to [0, 1],
    eigenvector and Katz over their maximum. NaN and negatives become 0. A
    graph with a factor may stand for the frame; ids are then its codes.
    """
    if metric not in METRICS:
        raise ValidationError(f"unknown metric {metric!r}", field="metrics", value=metric, expected=str(METRICS))
    if isinstance(frame, EdgeList) and (frame.factor is None or metric not in ("eigenvector", "pagerank", "katz")):
        frame = as_frame(frame)
    if not isinstance(frame, EdgeList):
        frame = checkpointed(as_frame(frame))
    elif nodes is None:
        nodes = frame.factor.select(F.col("p").alias("node_id"))
    all_, seen = measured(_nodes(frame, nodes), F.count("*").alias("n"))
    n = seen["n"]
    if metric.endswith("degree"):
        out = _degree(frame, metric, directed, all_)
        below = (n - 1) * (2 if directed and metric == "degree" else 1)
    elif metric in ("betweenness", "closeness"):
        out = shortest_path_sums(frame, all_, directed, metric)
        below = n - 1 if metric == "closeness" else (n - 1) * (n - 2) / (1 if directed else 2)
    else:
        out = power_iteration(frame, all_, metric, directed)
        below = None
    value = F.col("value")
    if normalized and below is not None:
        value = value / F.lit(float(below)) if below > 0 else F.lit(0.0)
    elif normalized:
        lo, hi = F.min("value").alias("lo"), F.max("value").alias("hi")
        out = out.crossJoin(F.broadcast(out.agg(lo, hi)))
        value = F.coalesce(F.try_divide(value - F.col("lo"), F.col("hi") - F.col("lo")) if metric == "pagerank" else F.try_divide(value, F.col("hi")), F.lit(0.0))
    clean: Column = F.when(F.isnan(value) | (value < 0), F.lit(0.0)).otherwise(value)
    return out.select("node_id", clean.alias("value"))


def extract_centrality(graph: EdgeList, id_mapper: IDMapper, metrics: list[str] | None = None, normalized: bool = True, n_jobs: int = -1) -> DataFrame:
    """``node_id`` and ``{metric}_centrality`` for every node, sorted by id; n_jobs means nothing here."""
    metrics = ["degree", "betweenness", "closeness", "eigenvector"] if metrics is None else metrics
    bad = [m for m in metrics if m not in METRICS]
    if bad or not metrics:
        raise ValidationError(f"unknown metrics {bad}" if bad else "there are no metrics", field="metrics", value=bad, expected=str(METRICS))
    frame = graph.weighted().toDF("source_id", "target_id", "weight")
    nodes = id_mapper.nodes.select(F.col("code").alias("node_id"))
    out = id_mapper.nodes.select("node_id", "code")
    for m in dict.fromkeys(metrics):
        values = centrality(graph if graph.factor is not None else frame, m, nodes, graph.directed, normalized).select(F.col("node_id").alias("code"), F.col("value").alias(f"{m}_centrality"))
        out = out.join(values, "code", "left").fillna(0.0, [f"{m}_centrality"])
    return out.drop("code").orderBy("node_id")


def centrality_summary(centrality_df: DataFrame) -> DataFrame:
    """``metric, count, mean, std, min, max, median, q25, q75`` of every centrality column, quantiles interpolated."""
    columns = [c for c in centrality_df.columns if c != "node_id"]
    long = centrality_df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    q = lambda p, name: F.percentile("v", F.lit(p)).alias(name)
    return long.groupBy("metric").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), q(0.5, "median"), q(0.25, "q25"), q(0.75, "q75"))


def get_centrality_summary(centrality_df: DataFrame) -> dict[str, dict[str, float]]:
    return {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in centrality_summary(centrality_df).collect()}


def identify_central_nodes(centrality_df: DataFrame, metric: str = "betweenness_centrality", top_k: int = 10, threshold: float | None = None) -> list[Any]:
    """Ids of the top_k nodes, of at least the threshold if there is one; ties by id."""
    if metric not in centrality_df.columns:
        raise ValidationError(f"column {metric} is missing", field="metric", value=centrality_df.columns)
    df = centrality_df if threshold is None else centrality_df.where(F.col(metric) >= threshold)
    return [r[0] for r in df.orderBy(F.desc(metric), "node_id").limit(top_k).select("node_id").collect()]


def average_rank(df: DataFrame, column: str, to: str) -> DataFrame:
    """df with the average rank of a column's value: counts of distinct values are ordered, not rows."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.orderBy("__v"))
    ranks = counts.select("__v", (upto - (F.col("__c") - 1) / 2).alias(to))
    return df.join(ranks, df[column].eqNullSafe(ranks["__v"])).drop("__v")


def compare_centrality_metrics(centrality_df: DataFrame, metric1: str, metric2: str) -> dict[str, float]:
    """Pearson's and Spearman's correlation (0 where undefined) and the number of nodes."""
    missing = [m for m in (metric1, metric2) if m not in centrality_df.columns]
    if missing:
        raise ValidationError(f"columns are missing: {missing}", field="metric", value=missing)
    df = centrality_df.select(F.col(metric1).cast("double").alias("x"), F.col(metric2).cast("double").alias("y")).dropna()
    ranked = average_rank(average_rank(df, "x", "rx"), "y", "ry")
    p, s, n = ranked.agg(F.corr("x", "y"), F.corr("rx", "ry"), F.count("*")).first()
    fix = lambda v: 0.0 if v is None or v != v else v
    return {"pearson": fix(p), "spearman": fix(s), "n_nodes": n}
