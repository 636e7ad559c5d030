"""Filters of nodes and edges, and neighbourhoods of seeds."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, as_frame, endpoints
from netspark.errors import ComputationError, ConfigurationError, ValidationError, validate_parameter
from netspark.operators.centrality import centrality, power_iteration
from netspark.operators.components import giant_component
from netspark.operators.construct import induced
from netspark.session import checkpointed, released

log = logging.getLogger("netspark.filters")
NODE_FILTERS = ["min_degree", "max_degree", "giant_component_only", "nodes", "exclude_nodes", "centrality"]
EDGE_FILTERS = ["min_weight", "min_source_degree", "max_source_degree", "min_target_degree", "max_target_degree"]


def _ids(values: Iterable[Any] | DataFrame, like: DataFrame, column: str = "source_id") -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).alias("node_id")).distinct()
    return like.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(values)], "node_id " + like.schema[column].dataType.simpleString())


def node_filter(frame: DataFrame, kind: str, value: Any, directed: bool = False) -> DataFrame:
    """``node_id`` of the nodes that pass one filter."""
    if kind in ("min_degree", "max_degree"):
        degree = endpoints(frame).groupBy("node_id").count()
        return degree.where(F.col("count") >= value if kind == "min_degree" else F.col("count") <= value).select("node_id")
    if kind == "giant_component_only":
        return giant_component(frame) if value else endpoints(frame).distinct()
    if kind == "nodes":
        return endpoints(frame).distinct().join(_ids(value, frame), "node_id", "left_semi")
    if kind == "exclude_nodes":
        return endpoints(frame).distinct().join(_ids(value, frame), "node_id", "left_anti")
    metric = value["metric"]
    return centrality(frame, metric, directed=directed).where(F.col("value") >= value["min_value"]).select("node_id")


def edge_filter(frame: DataFrame, kind: str, value: float) -> DataFrame:
    """frame's rows with ``ok``: whether they pass one filter. Degrees of a role count distinct neighbours on the input."""
    if kind == "min_weight":
        return frame.withColumn("ok", F.col("weight") >= value)
    own, other = ("source_id", "target_id") if "source" in kind else ("target_id", "source_id")
    degree = frame.groupBy(F.col(own).alias("__id")).agg(F.count_distinct(other).alias("__d"))
    passes = F.col("__d") >= value if kind.startswith("min") else F.col("__d") <= value
    return frame.join(degree, frame[own] == degree["__id"]).withColumn("ok", passes).drop("__id", "__d")


def filter_edges(frame: DataFrame, filters: dict[str, Any], combine: str = "and", protected: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """Rows of frame that pass.

    Node filters combine into one set and edge filters into one predicate, each
    by combine; an edge stays if both ends are in the set and the predicate
    holds, or if an end is protected.
    """
    unknown = [k for k in filters if k not in NODE_FILTERS + EDGE_FILTERS]
    if unknown:
        raise ValidationError(f"unknown filters {unknown}", field="filters", value=unknown, expected=str(NODE_FILTERS + EDGE_FILTERS))
    validate_parameter(combine, ["and", "or"], "combine")
    out, ok = frame, F.lit(True)
    for i, (kind, value) in enumerate((k, v) for k, v in filters.items() if k in EDGE_FILTERS):
        out = edge_filter(out, kind, value).withColumnRenamed("ok", f"__e{i}")
    edge_oks = [F.col(c) for c in out.columns if c.startswith("__e")]
    if edge_oks:
        ok = _fold(edge_oks, combine)
    sets = [node_filter(frame, k, v, directed) for k, v in filters.items() if k in NODE_FILTERS]
    if sets:
        nodes = sets[0].distinct()
        for s in sets[1:]:
            nodes = nodes.intersect(s) if combine == "and" else nodes.union(s).distinct()
        for end in ("source_id", "target_id"):
            side = nodes.select(F.col("node_id").alias("__id"), F.lit(True).alias("__in_" + end))
            out = out.join(side, out[end] == side["__id"], "left").drop("__id")
        ok = ok & F.coalesce("__in_source_id", F.lit(False)) & F.coalesce("__in_target_id", F.lit(False))
    if protected is not None:
        for end in ("source_id", "target_id"):
            side = protected.select(F.col(protected.columns[0]).alias("__id"), F.lit(True).alias("__p_" + end))
            out = out.join(side, out[end] == side["__id"], "left").drop("__id")
        ok = ok | F.coalesce("__p_source_id", F.lit(False)) | F.coalesce("__p_target_id", F.lit(False))
    return out.where(ok).select(*frame.columns)


def _fold(columns: list[Column], combine: str) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c if combine == "and" else out | c
    return out


def filter_graph(edges: EdgeList | DataFrame, id_mapper: IDMapper | None = None, filters: dict[str, Any] | None = None, combine: str = "and", *, output_format: str | None = None, protected_nodes: Iterable[Any] | DataFrame | None = None, keep_disconnected: bool = False) -> Any:
    """The edges that pass all (or any) of the filters; a frame for a frame, (edge list, mapper) for an edge list, renumbered unless keep_disconnected. An empty result is an error."""
    if not filters:
        raise ValidationError("there are no filters", field="filters")
    plain = isinstance(edges, DataFrame)
    frame = as_frame(edges, id_mapper)
    protected = None if protected_nodes is None else _ids(protected_nodes, frame)
    directed = not plain and edges.directed
    out = filter_edges(frame, filters, combine, protected, directed)
    if out.isEmpty():
        raise ComputationError("no edge passes the filters", operation="filter_graph")
    if plain and output_format in (None, "frame"):
        return out
    if id_mapper is None:
        raise ValidationError("an edge list needs its id_mapper", field="id_mapper")
    if output_format == "frame":
        return out
    coded = id_mapper.encode(id_mapper.encode(out, "source_id", "src"), "target_id", "tgt").select("src", "tgt", "weight")
    result = edges.with_df(coded if edges.is_weighted() else coded.select("src", "tgt"))
    if keep_disconnected:
        return result, id_mapper
    ends = coded.select(F.explode(F.array("src", "tgt")).alias("code"))
    if protected is not None:
        ends = ends.union(id_mapper.encode(protected, "node_id", "code").select("code"))
    return induced(result, id_mapper, ends)


def _steps(graph: EdgeList, direction: str) -> DataFrame:
    """``a, b, weight``: steps from a to b, both ways for undirected graphs."""
    e = graph.weighted()
    back = e.select(F.col("tgt").alias("a"), F.col("src").alias("b"), "weight")
    out = e.toDF("a", "b", "weight")
    return out.union(back) if direction == "both" or not graph.directed else back if direction == "in" else out


def khop(graph: EdgeList, seeds: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """``code, hop`` of the nodes within so many steps of seeds (code): each round joins the newest nodes only."""
    steps = _steps(graph, direction).select("a", "b").distinct()
    seen = checkpointed(seeds.select("code").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, hops + 1):
        fresh = seen.where(F.col("hop") == hop - 1).join(steps, F.col("code") == F.col("a")).select(F.col("b").alias("code")).distinct().join(seen.select("code"), "code", "left_anti")
        then = checkpointed(seen.unionByName(fresh.withColumn("hop", F.lit(hop))))
        grown = not then.where(F.col("hop") == hop).isEmpty()
        released(seen)
        seen = then
        if not grown:
            break
    return seen


def personalised_pagerank(graph: EdgeList, seeds: DataFrame, nodes: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6, direction: str = "both") -> DataFrame:
    """``code, ppr``: alpha P'x + (1 - alpha) s from the uniform s over seeds; mass of nodes without steps returns to the seeds.

    The rounds are those of power_iteration(); they end when all changes add up to less than tol.
    """
    steps = graph if graph.factor is not None else _steps(graph, direction).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "weight")
    start = seeds.select("code").distinct()
    k = start.count()
    restart = start.select(F.col("code").alias("node_id"), F.lit(1.0 / k).alias("s"))
    x = power_iteration(steps, nodes.select(F.col("code").alias("node_id")), "pagerank", True, max_iter, tol, alpha, restart=restart, total_change=True)
    return x.select(F.col("node_id").alias("code"), F.col("value").alias("ppr"))


def tightness_expansion(edges: list[tuple[int, int, float]], seeds: Iterable[int], alpha: float = 1.0) -> set[int]:
    """Local tightness expansion (Huang et al. 2011) from seeds on one machine: the most similar neighbour joins while the tunable tightness gain is positive."""
    adjacent: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        if a != b:
            adjacent.setdefault(a, {})[b] = adjacent.get(a, {}).get(b, 0.0) + w
            adjacent.setdefault(b, {})[a] = adjacent.get(b, {}).get(a, 0.0) + w
    norm = {n: (1 + sum(w * w for w in x.values())) ** 0.5 for n, x in adjacent.items()}

    def similar(a: int, b: int) -> float:
        x, y = adjacent[a], adjacent[b]
        common = sum(w * y[n] for n, w in x.items() if n in y)
        return (common + 2 * x.get(b, 0.0)) / (norm[a] * norm[b])

    inside = {s for s in seeds if s in adjacent}
    s_in, s_out, shell = 0.0, 0.0, {}
    for s in sorted(inside):
        for n in adjacent[s]:
            if n in inside:
                s_in += similar(s, n)
            else:
                s_out += similar(s, n)
                shell[n] = shell.get(n, 0.0) + similar(s, n)
    rejected: set[int] = set()
    while candidates := {n: x for n, x in shell.items() if n not in rejected}:
        best = min(candidates, key=lambda n: (-candidates[n], n))
        own = shell[best]
        away = sum(similar(best, n) for n in adjacent[best] if n not in inside)
        gain = (s_out / s_in if s_in else float("inf")) - (alpha * away - own) / (2 * own) if own else -1.0
        if gain <= 0:
            rejected.add(best)
            continue
        inside.add(best)
        s_in, s_out = s_in + 2 * own, s_out - own + away
        del shell[best]
        for n in adjacent[best]:
            if n not in inside:
                shell[n] = shell.get(n, 0.0) + similar(best, n)
    return inside | set(seeds)


#: Edges that tightness_expansion() takes on one machine.
LTE_EDGES = 2_000_000


def filter_by_seed_proximity(graph: EdgeList, id_mapper: IDMapper, seeds: Any, method: str = "khop", *, hops: int = 2, direction: str = "both", ppr_alpha: float = 0.85, top_n: int | None = None, min_ppr: float | None = None, max_iter: int = 100, tol: float = 1e-6, lte_alpha: float = 1.0, include_seeds: bool = True, seed_column: str = "node_id") -> tuple[EdgeList, IDMapper]:
    """Subgraph around seeds: within hops steps, by personalised PageRank (min_ppr, then top_n), or by local tightness expansion, which takes up to LTE_EDGES edges."""
    validate_parameter(method, ["khop", "ppr", "lte"], "method")
    validate_parameter(direction, ["out", "in", "both"], "direction")
    if method == "khop" and hops < 0:
        raise ConfigurationError("hops must be at least 0", parameter="hops", value=hops)
    if method == "ppr" and not 0 < ppr_alpha < 1:
        raise ConfigurationError("ppr_alpha must lie between 0 and 1", parameter="ppr_alpha", value=ppr_alpha)
    if method == "ppr" and top_n is None and min_ppr is None:
        raise ConfigurationError("ppr needs top_n or min_ppr", parameter="top_n", value=None)
    given = seeds.select(F.col(seed_column).alias("node_id")) if isinstance(seeds, DataFrame) else _ids(seeds[seed_column].tolist() if hasattr(seeds, "columns") else seeds, id_mapper.nodes, "node_id")
    codes = id_mapper.nodes.join(given.distinct(), "node_id", "left_semi").select("code")
    known, all_ = codes.count(), given.distinct().count()
    if not known:
        raise ValidationError("no seed is in the graph", field="seeds")
    if known < all_:
        log.warning("%d seeds are not in the graph", all_ - known)
    if method == "khop":
        keep = khop(graph, codes, hops, direction).select("code")
    elif method == "ppr":
        x = personalised_pagerank(graph, codes, id_mapper.nodes, ppr_alpha, max_iter, tol, direction)
        x = x.where(F.col("ppr") >= (min_ppr if min_ppr is not None else 0.0))
        keep = (x.orderBy(F.desc("ppr"), "code").limit(top_n) if top_n is not None else x).select("code")
    else:
        rows = graph.weighted().limit(LTE_EDGES + 1).collect()
        if len(rows) > LTE_EDGES:
            raise ComputationError(f"local tightness expansion takes up to {LTE_EDGES} edges", operation="lte")
        found = tightness_expansion([tuple(r) for r in rows], [r[0] for r in codes.collect()], lte_alpha)
        keep = graph.df.sparkSession.createDataFrame([(c,) for c in sorted(found)], "code long")
    return induced(graph, id_mapper, keep.union(codes) if include_seeds else keep)
