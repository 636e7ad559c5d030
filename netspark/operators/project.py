"""Projections of bipartite edges onto one side."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, dense_codes, from_frame
from netspark.errors import GraphConstructionError, ValidationError, validate_parameter
from netspark.operators.construct import partitions
from netspark.operators.meets import summed_pairs
from netspark.session import checkpointed, released, small
from netspark.sources.load import load_edges

WEIGHTS = ("count", "jaccard", "overlap")
#: Members of a shared id that meet in one list (summed_pairs()).
PART = 1024


def projected_pairs(frame: DataFrame, projected: str, shared: str, weight_method: str = "count") -> DataFrame:
    """``source_id < target_id, weight`` for pairs of projected ids with a common shared id.

    Duplicate edges count once and input weights don't matter. Pairs are added
    up by summed_pairs(), without a row for each meeting in a shared id; ids and
    degrees join them afterwards.
    """
    validate_parameter(weight_method, list(WEIGHTS), "weight_method")
    pairs, codes, n = bipartite_codes(frame, projected, shared)
    common = summed_pairs(pairs, n, part=PART)
    if weight_method == "count":
        return _decoded(common.toDF("source_id", "target_id", "weight"), codes)
    degree = pairs.groupBy("p").agg(F.count("*").cast("double").alias("d"))
    codes = checkpointed(codes.join(degree, F.col("code") == F.col("p")).select("node_id", "code", "d"))
    below = F.col("da") + F.col("db") - F.col("weight") if weight_method == "jaccard" else F.least("da", "db")
    return _decoded(common.toDF("source_id", "target_id", "weight"), codes, F.col("weight") / below)


def bipartite_codes(frame: DataFrame, projected: str, shared: str) -> tuple[DataFrame, DataFrame, int]:
    """Distinct ``s, p`` of a frame's edges with p in codes, the ``node_id, code`` of p in the order of ids, and how many these are."""
    named = checkpointed(frame.select(F.col(projected).alias("p"), F.col(shared).alias("s")).dropna().distinct())
    codes = checkpointed(dense_codes(named, "p"))
    pairs = checkpointed(named.join(small(codes), F.col("p") == F.col("node_id")).select("s", F.col("code").alias("p")))
    released(named)
    return pairs, codes, codes.count()


def projected_graph(frame: DataFrame, projected: str, shared: str) -> tuple[EdgeList, IDMapper]:
    """The undirected graph of projected_pairs() by count, and the mapper of its nodes.

    Its edges are made whenever they are read and written nowhere; propagation, power
    iterations and samples go along its factor, the rows whose shared id has two ids at least.
    """
    named = checkpointed(frame.select(F.col(projected).alias("p"), F.col(shared).alias("s")).dropna().distinct())
    keys = checkpointed(named.groupBy("s").agg(F.count("*").alias("d")).where("d > 1").select("s", F.monotonically_increasing_id().alias("key")))
    rows = checkpointed(named.join(small(keys), "s").select("p", F.col("key").alias("s")))
    released(named)
    factor, codes, n = bipartite_codes(rows, "p", "s")
    edges = summed_pairs(factor, n, part=PART).toDF("src", "tgt", "weight")
    return EdgeList(edges, n_nodes=n, factor=factor), IDMapper(codes)


def _decoded(pairs: DataFrame, codes: DataFrame, weight: Column | None = None) -> DataFrame:
    """Pairs of codes as pairs of ids; a weight may read both ends' d of codes as da and db."""
    side = lambda s, c: small(codes).withColumnsRenamed({"node_id": s, "code": c, "d": "d" + s})
    out = pairs.join(side("a", "source_code"), F.col("source_id") == F.col("source_code")).join(side("b", "target_code"), F.col("target_id") == F.col("target_code"))
    return out.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), (F.col("weight") if weight is None else weight).alias("weight"))


def calculate_projection_weight(neighbors1: set, neighbors2: set, shared_neighbors: int, weight_method: str) -> float:
    """The three weights of one pair, as plain arithmetic."""
    if weight_method == "count":
        return float(shared_neighbors)
    below = len(neighbors1 | neighbors2) if weight_method == "jaccard" else min(len(neighbors1), len(neighbors2))
    return shared_neighbors / below if below else 0.0


def project_bipartite(edges: EdgeList | DataFrame, id_mapper: IDMapper | None = None, projection_mode: str = "source", weight_method: str = "count", verbose: bool = True, *, output_format: str | None = None) -> DataFrame | tuple[EdgeList, IDMapper]:
    """Edges between ids of one side that share a neighbour on the other.

    A frame (source_id, target_id) gives a frame; an edge list gives an edge
    list and its mapper, with all nodes of the side, unless output_format says
    ``frame``. Sides of an edge list are those its mapper records, or a
    two-colouring.
    """
    validate_parameter(projection_mode, ["source", "target"], "projection_mode")
    validate_parameter(weight_method, list(WEIGHTS), "weight_method")
    columns = ("source_id", "target_id") if projection_mode == "source" else ("target_id", "source_id")
    if isinstance(edges, DataFrame):
        frame, nodes = edges, edges.select(F.col(columns[0]).alias("node_id"))
        wanted = output_format or "frame"
    else:
        if id_mapper is None:
            raise ValidationError("an edge list needs its id_mapper", field="id_mapper")
        frame, wanted = edges.frame(id_mapper), output_format or "edgelist"
        if edges.bipartite:
            nodes = frame.select(F.col(columns[0]).alias("node_id"))
        else:
            sides = partitions(edges, id_mapper)
            if sides is None:
                raise GraphConstructionError("the graph is not bipartite", operation="project_bipartite")
            own = sides.where("is_source" if projection_mode == "source" else "is_target").select("node_id")
            swap = frame.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")
            frame = frame.union(swap).join(own, F.col(columns[0]) == F.col("node_id"), "left_semi")
            nodes = own
    out = projected_pairs(frame, *columns, weight_method)
    return out if wanted == "frame" else from_frame(out, nodes=nodes)


def temporal_pairs(df: DataFrame, intermediate_col: str, projected_col: str, timestamp_col: str | None, weight_col: str | None = None, add_edge_weights: bool = True, remove_self_loops: bool = True, time_decay: bool = False, order: list[Column] | None = None) -> DataFrame:
    """``source_id, target_id, weight``: who shared an intermediate later points to whom shared it before.

    Of repeated shares the latest counts. Positions within an intermediate go
    from the latest to the earliest; equal times are ordered by the projected
    id. A pair's weight is the mean of both shares' weights (1 without any),
    with time_decay over 1 plus the days between, summed over intermediates
    by summed_pairs().
    """
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    time = (F.col(timestamp_col) if timestamp_col else F.lit(None)).cast("timestamp")
    given = [o.alias(f"o{k}") for k, o in enumerate(order or [])]
    rows = df.select(F.col(intermediate_col).alias("i"), F.col(projected_col).alias("p"), weight.alias("w"), time.alias("t"), *given).dropna(subset=["i", "p"])
    by = [F.col(f"o{k}") for k in range(len(given))] or [F.col("t").desc_nulls_last(), F.col("p")]
    one = rows.withColumn("k", F.row_number().over(Window.partitionBy("i", "p").orderBy(*by, "w"))).where("k = 1")
    ranked = checkpointed(one.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy(*by))).select("i", "k", "p", "w", "t"))
    codes = checkpointed(dense_codes(ranked, "p"))
    ranked = ranked.join(small(codes), F.col("p") == F.col("node_id"))
    decay, weighted = bool(add_edge_weights and time_decay and timestamp_col), bool(add_edge_weights and weight_col)
    if not decay and not weighted:
        return _decoded(summed_pairs(checkpointed(ranked.select(F.col("i").alias("s"), F.col("code").alias("p"), F.col("k").cast("long").alias("k"))), codes.count(), True, part=PART).toDF("source_id", "target_id", "weight"), codes)
    w, t = F.col("w") if weighted else F.lit(1.0), F.unix_micros("t") if decay else F.lit(0).cast("long")
    shares = ranked.select(F.col("i").alias("s"), F.col("code").alias("p"), F.col("k").cast("long").alias("k"), F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(t, F.lit(0)).alias("t"), (w.isNotNull() & t.isNotNull()).alias("ok"))

    def weigh(a: dict, b: dict) -> np.ndarray:
        both = (a["w"] + b["w"]) / 2
        return both / (1 + np.abs(a["t"] - b["t"]) // 1_000_000 / 86400) if decay else both

    return _decoded(summed_pairs(checkpointed(shares), codes.count(), True, weigh, part=PART).toDF("source_id", "target_id", "weight"), codes)


def temporal_bipartite_to_unipartite(edgelist: str | Path | DataFrame | EdgeList, source_col: str = "source", target_col: str = "target", timestamp_col: str | None = None, weight_col: str | None = None, intermediate_col: str = "target", projected_col: str = "source", remove_self_loops: bool = True, add_edge_weights: bool = True, time_decay: bool = False, verbose: bool = True, *, id_mapper: IDMapper | None = None, output_format: str | None = None, order: list[Column] | None = None, spark: SparkSession | None = None) -> DataFrame | tuple[EdgeList, IDMapper]:
    """Directed projection by order of time (temporal_pairs()).

    ``intermediate_col`` and ``projected_col`` say which of ``source`` and
    ``target`` plays which part. Without a timestamp, order must say how the
    shares of an intermediate follow each other, latest first. Output is an
    edge list and mapper, or a frame.
    """
    for value, name in ((intermediate_col, "intermediate_col"), (projected_col, "projected_col")):
        validate_parameter(value, ["source", "target", source_col, target_col], name)
    if isinstance(edgelist, EdgeList):
        if id_mapper is None:
            raise ValidationError("an edge list needs its id_mapper", field="id_mapper")
        df = id_mapper.decode(id_mapper.decode(edgelist.df, "src", "__s"), "tgt", "__t").drop("src", "tgt")
        df = df.withColumnsRenamed({"__s": source_col, "__t": target_col})
    else:
        df = load_edges(edgelist, spark)
    name = {"source": source_col, "target": target_col}
    middle, side = name.get(intermediate_col, intermediate_col), name.get(projected_col, projected_col)
    if middle == side:
        raise ValidationError("intermediate and projected columns must differ", field="projected_col", value=side)
    missing = [c for c in (middle, side, timestamp_col, weight_col) if c and c not in df.columns]
    if missing:
        raise ValidationError(f"columns are missing: {missing}", field="edgelist", value=df.columns)
    if timestamp_col is None and order is None:
        raise ValidationError("without timestamp_col, order must be given", field="timestamp_col")
    if timestamp_col and dict(df.dtypes)[timestamp_col] == "string":
        df = df.withColumn(timestamp_col, F.to_timestamp(timestamp_col))
    out = temporal_pairs(df, middle, side, timestamp_col, weight_col, add_edge_weights, remove_self_loops, time_decay, order)
    return out if output_format == "frame" else from_frame(out, directed=True, nodes=df.select(F.col(side).alias("node_id")))
