"""Smaller graphs for the eye: communities as nodes, backbones of leading nodes, fires."""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, endpoints
from netspark.errors import ComputationError, ValidationError, validate_parameter
from netspark.operators.backbone import METHODS, apply_backbone
from netspark.operators.communities import louvain
from netspark.operators.construct import induced
from netspark.session import checkpointed, fits, small

log = logging.getLogger("netspark.reduce")
#: Edges of a graph that the driver takes for a fire.
FIRE_EDGES = 5_000_000
PREFIXES = ("", "out_", "in_")


def wanted(count: int | None, fraction: float | None, total: int, what: str) -> int | None:
    """A target as a number: given so, or as a share of total; at most one of both."""
    if count is not None and fraction is not None:
        raise ValidationError(f"give a number or a fraction of {what}, not both", field=f"target_{what}")
    if count is not None:
        if count < 1:
            raise ValidationError(f"target_{what} must be positive", field=f"target_{what}", value=count)
        return int(count)
    if fraction is None:
        return None
    if not 0 < fraction <= 1:
        raise ValidationError("a fraction lies in (0, 1]", field=f"{what}_fraction", value=fraction)
    return max(1, round(fraction * total))


def directional(glp_results: Any, glp_direction: str = "both") -> DataFrame | None:
    """One frame of a propagation's result; an (out, in) pair is chosen from, or joined with prefixes."""
    if glp_results is None:
        return None
    if not isinstance(glp_results, tuple):
        if "node_id" not in glp_results.columns:
            raise ValidationError("glp_results lack node_id", field="glp_results")
        return glp_results
    validate_parameter(glp_direction, ["out", "in", "both"], "glp_direction")
    if len(glp_results) != 2:
        raise ValidationError("glp_results must be an (out, in) pair", field="glp_results")
    if glp_direction != "both":
        return glp_results[glp_direction == "in"]
    sides = [df.select("node_id", *[F.col(c).alias(prefix + c) for c in df.columns if c != "node_id"]) for df, prefix in zip(glp_results, PREFIXES[1:], strict=True)]
    return sides[0].join(sides[1], "node_id", "full")


def quotient_edges(edges: DataFrame, parts: DataFrame, keep_self_loops: bool = True) -> DataFrame:
    """``src, tgt, weight`` between communities: sums over edges (src, tgt, weight) by parts (code, community); (a, b) and (b, a) stay apart, as directed edges do."""
    p = small(checkpointed(parts.select("code", "community")))
    x = edges.join(p.toDF("src", "a"), "src").join(p.toDF("tgt", "b"), "tgt")
    out = x.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.sum("weight").alias("weight"))
    return out if keep_self_loops else out.where("src <> tgt")


def supernode_attributes(members: DataFrame, prefix: str = "community_", glp: DataFrame | None = None) -> DataFrame:
    """``node_id, member_count, member_ids`` of ``node_id, community``; with a propagation's result also mean probabilities and confidence, the most frequent label (the first of equals) and the share of seeds."""
    x = members if glp is None else members.join(glp, "node_id", "left")
    aggs = [F.count("*").alias("member_count"), F.concat_ws("|", F.sort_array(F.collect_list(F.col("node_id").cast("string")))).alias("member_ids")]
    if glp is not None:
        aggs += [F.avg(c).alias(c) for c in glp.columns if c.endswith("_prob")]
        for p in PREFIXES:
            if f"{p}confidence" in glp.columns:
                aggs.append(F.avg(f"{p}confidence").alias(f"{p}confidence"))
            if f"{p}is_seed" in glp.columns:
                aggs.append(F.avg(F.col(f"{p}is_seed").cast("double")).alias(f"{p}seed_fraction"))
    out = x.groupBy("community").agg(*aggs)
    for p in PREFIXES if glp is not None else ():
        if f"{p}dominant_label" in glp.columns:
            counts = x.where(F.col(f"{p}dominant_label").isNotNull()).groupBy("community", F.col(f"{p}dominant_label").alias("l")).count()
            top = counts.groupBy("community").agg(F.min_by("l", F.struct((-F.col("count")).alias("n"), "l")).alias(f"{p}dominant_label"))
            out = out.join(top, "community", "left")
    return out.select(F.concat(F.lit(prefix), F.col("community").cast("string")).alias("node_id"), *[c for c in out.columns if c != "community"])


def bisected(graph: EdgeList, id_mapper: IDMapper, target: int, seed: int | None, low: float = 0.1, high: float = 10.0, most: int = 8, tolerance: float = 0.1) -> tuple[DataFrame, float]:
    """Communities (code, community) at the resolution whose number of them comes nearest to target, and that resolution."""
    best = None
    for i in range(most):
        gamma = (low + high) / 2
        parts = checkpointed(louvain(graph, id_mapper, gamma, None if seed is None else seed + i))
        k = parts.select("community").distinct().count()
        away = abs(k - target) / max(target, 1)
        if best is None or away < best[0]:
            best = (away, parts, gamma)
        if away <= tolerance:
            break
        low, high = (gamma, high) if k < target else (low, gamma)
    else:
        log.warning("no resolution gives %d communities; the nearest is off by %.0f %%", target, 100 * best[0])
    return best[1], best[2]


def reduce_by_grouping(graph: EdgeList, id_mapper: IDMapper, *, glp_results: Any = None, glp_direction: str = "both", resolution: float = 1.0, target_nodes: int | None = None, node_fraction: float | None = None, target_edges: int | None = None, edge_fraction: float | None = None, resolution_search: str = "fixed", keep_self_loops: bool = True, supernode_id_prefix: str = "community_", random_seed: int | None = None) -> tuple[EdgeList, IDMapper, DataFrame]:
    """The graph of communities, its mapper, and the communities' attributes."""
    validate_parameter(resolution_search, ["fixed", "bisect"], "resolution_search")
    if target_edges is not None or edge_fraction is not None:
        raise ValidationError("grouping aims at nodes, not at edges", field="target_edges")
    n = id_mapper.size()
    target = wanted(target_nodes, node_fraction, n, "nodes")
    if resolution_search == "bisect":
        if target is None:
            raise ValidationError("bisect needs target_nodes or node_fraction", field="target_nodes")
        parts, _ = bisected(graph, id_mapper, target, random_seed)
    else:
        parts = checkpointed(louvain(graph, id_mapper, resolution, random_seed))
    k = parts.select("community").distinct().count()
    if k == 1 and target is not None and target > 1:
        raise ComputationError(f"there is one community only, {target} are wanted", operation="reduce_by_grouping")
    if resolution_search == "fixed" and target is not None and abs(k - target) > 0.1 * target:
        log.warning("%d communities instead of %d; resolution_search='bisect' comes nearer", k, target)
    edges = quotient_edges(graph.weighted(), parts, keep_self_loops)
    names = parts.select("community").distinct().select(F.concat(F.lit(supernode_id_prefix), F.col("community").cast("string")).alias("node_id"), F.col("community").alias("code"))
    members = id_mapper.nodes.join(parts, "code").select("node_id", "community")
    return EdgeList(edges, graph.directed, n_nodes=k), IDMapper(names), supernode_attributes(members, supernode_id_prefix, directional(glp_results, glp_direction))


def _attached(mapper: IDMapper, glp: DataFrame | None) -> DataFrame:
    nodes = mapper.nodes.select("node_id")
    return nodes if glp is None else nodes.join(glp, "node_id", "left")


def reduce_by_influence(graph: EdgeList, id_mapper: IDMapper, *, glp_results: Any = None, glp_direction: str = "both", backbone_method: str = "noise_corrected", alpha: float = 0.05, threshold: float = 1.0, target_nodes: int | None = None, node_fraction: float | None = None, target_edges: int | None = None, edge_fraction: float | None = None, keep_disconnected: bool = False) -> tuple[EdgeList, IDMapper, DataFrame]:
    """A backbone, cut to its nodes of highest degree (then least code)."""
    validate_parameter(backbone_method, METHODS, "backbone_method")
    n = id_mapper.size()
    wanted(target_nodes, node_fraction, n, "nodes")
    most = wanted(target_edges, edge_fraction, graph.number_of_edges() if edge_fraction is not None else 0, "edges")
    extra = {"target_edges": most} if most is not None and backbone_method in ("disparity", "weight") else {}
    found, mapper = apply_backbone(graph, id_mapper, backbone_method, alpha=alpha, threshold=threshold, keep_disconnected=keep_disconnected, output_format="graph", **extra)[:2]
    left = mapper.size()
    target = wanted(target_nodes, node_fraction, left, "nodes")
    if target is not None and target < left:
        degree = endpoints(found.frame()).groupBy("node_id").count()
        keep = mapper.nodes.select("code").join(degree, F.col("code") == F.col("node_id"), "left").orderBy(F.desc(F.coalesce("count", F.lit(0))), "code").limit(target)
        found, mapper = induced(found, mapper, checkpointed(keep.select("code")))
    return found, mapper, _attached(mapper, directional(glp_results, glp_direction))


class _Near:
    """Neighbours of nodes as a dict of ascending lists gives them, out-edges before in-edges if undirected; read from the edges, or the factor, of one node after the other."""

    def __init__(self, graph: EdgeList, backward: bool = False):
        self.graph, self.backward, self.last = graph, backward, (None, [])

    def get(self, u: int, default: tuple = ()) -> list[int]:
        if self.last[0] != u:
            self.last = (u, self._read(u))
        return self.last[1]

    def _read(self, u: int) -> list[int]:
        if self.graph.factor is not None:
            rows = self.graph.factor
            of = rows.where(F.col("p") == u).select("s")
            ids = sorted(r[0] for r in rows.join(F.broadcast(of), "s", "left_semi").where(F.col("p") != u).select("p").distinct().collect())
            return [v for v in ids if v > u] + [v for v in ids if v < u]  # edges go from the lesser code
        e = self.graph.df.select("src", "tgt")
        out = sorted(r[0] for r in e.where(F.col("src") == u).select("tgt").distinct().collect()) if not self.backward else []
        in_ = sorted(r[0] for r in e.where(F.col("tgt") == u).select("src").distinct().collect()) if self.backward or not self.graph.directed else []
        return in_ if self.backward else out + [v for v in in_ if v != u]


def burnt(forward: dict[int, list[int]] | _Near, backward: dict[int, list[int]] | _Near | None, n: int, target: int, forward_mean: float, backward_mean: float, first: Iterable[int] = (), most: int | None = None, seed: int | None = None) -> set[int]:
    """Forest fire (Leskovec and Faloutsos 2006) over 0..n-1: from a start, geometrically many unburnt neighbours catch fire, until target nodes burn; new starts follow a random order."""
    if target >= n:
        return set(range(n))
    rng = np.random.default_rng(seed)
    fires = 0
    on: set[int] = set()
    for start in [*first, *rng.permutation(n).tolist()]:
        if len(on) >= target or (most is not None and fires >= most):
            break
        if start in on:
            continue
        draw = rng if seed is None else np.random.default_rng(seed + fires + 1)
        on.add(start)
        queue = deque([start])
        while queue and len(on) < target:
            u = queue.popleft()
            for near, mean in ((forward, forward_mean), (backward, backward_mean)):
                fresh = [v for v in near.get(u, ()) if v not in on] if near is not None and mean > 0 else []
                if fresh and len(on) < target:
                    k = min(int(draw.geometric(1 / (1 + mean))) - 1, len(fresh), target - len(on))
                    chosen = draw.choice(fresh, size=k, replace=False).tolist() if k > 0 else []
                    on.update(chosen)
                    queue.extend(chosen)
        fires += 1
    return on


def reduce_by_sampling(graph: EdgeList, id_mapper: IDMapper, *, glp_results: Any = None, glp_direction: str = "both", target_nodes: int | None = None, node_fraction: float | None = None, target_edges: int | None = None, edge_fraction: float | None = None, forward_burn_mean: float = 1.5, backward_burn_mean: float = 0.4, seed_nodes: Iterable[Any] | None = None, max_restarts: int | None = None, random_seed: int | None = None) -> tuple[EdgeList, IDMapper, DataFrame]:
    """The subgraph of the nodes that a forest fire burns.

    A fire is sequential: up to FIRE_EDGES edges it burns on the driver, beyond it reads
    each burning node's neighbours from the edges, with the same outcome.
    """
    if target_edges is not None or edge_fraction is not None:
        raise ValidationError("sampling aims at nodes, not at edges", field="target_edges")
    n = id_mapper.size()
    target = wanted(target_nodes, node_fraction, n, "nodes")
    if target is None:
        raise ValidationError("sampling needs target_nodes or node_fraction", field="target_nodes")
    forward, backward = {}, {}
    if fits(graph.df, FIRE_EDGES):
        rows = graph.df.select("src", "tgt").distinct().toArrow()
        for a, b in sorted(zip(rows["src"].to_pylist(), rows["tgt"].to_pylist(), strict=True)):
            forward.setdefault(a, []).append(b)
            backward.setdefault(b, []).append(a)
        if not graph.directed:
            for b, xs in backward.items():
                forward.setdefault(b, []).extend(x for x in xs if x != b)
    else:
        forward, backward = _Near(graph), _Near(graph, backward=True)
    first = id_mapper.get_internal_batch(seed_nodes) if seed_nodes is not None else []
    on = burnt(forward, backward if graph.directed else None, n, target, forward_burn_mean, backward_burn_mean, first, max_restarts, random_seed)
    keep = graph.df.sparkSession.createDataFrame([(c,) for c in sorted(on)], "code long")
    found, mapper = induced(graph, id_mapper, keep)
    return found, mapper, _attached(mapper, directional(glp_results, glp_direction))
