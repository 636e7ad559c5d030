"""Communities by modularity: Louvain's method, consensus of several runs, stability."""

from __future__ import annotations

import logging
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper
from netspark.errors import ConfigurationError, ValidationError, validate_parameter
from netspark.session import checkpointed, released

log = logging.getLogger("netspark.communities")
#: Edges that the numpy kernel takes; larger graphs are first shrunk by rounds of Spark joins.
KERNEL_EDGES = 2_000_000
#: Rounds of moves before a large graph is shrunk.
ROUNDS = 6


def undirected(graph: EdgeList) -> DataFrame:
    """``a <= b, w``: summed weights of both directions."""
    e = graph.weighted()
    return e.groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.sum("weight").alias("w"))


def local_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """One level of Louvain's method over undirected edges: the community of each of n nodes."""
    off = a != b
    strength = np.bincount(a, w, n) + np.bincount(b, w, n)
    total = strength.sum()
    own = np.arange(n)
    if total <= 0 or not off.any():
        return own
    head, tail, weight = np.concatenate([a[off], b[off]]), np.concatenate([b[off], a[off]]), np.concatenate([w[off], w[off]])
    order = np.argsort(head, kind="stable")
    tail, weight = tail[order], weight[order]
    first = np.searchsorted(head[order], np.arange(n + 1))
    volume = strength.copy()
    moved = True
    while moved:
        moved = False
        for v in rng.permutation(n):
            i, j = first[v], first[v + 1]
            if i == j:
                continue
            near, back = np.unique(own[tail[i:j]], return_inverse=True)
            links = np.bincount(back, weight[i:j])
            volume[own[v]] -= strength[v]
            gain = links - gamma * strength[v] * volume[near] / total
            stay = -gamma * strength[v] * volume[own[v]] / total
            here = np.flatnonzero(near == own[v])
            stay += links[here[0]] if len(here) else 0.0
            best = int(np.argmax(gain))
            if gain[best] > stay + 1e-12:
                own[v] = near[best]
                moved = True
            volume[own[v]] += strength[v]
    return np.unique(own, return_inverse=True)[1]


def kernel(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, seed: int | None = None) -> np.ndarray:
    """Louvain's method on one machine: levels of local moves until none joins communities."""
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    size = n
    while True:
        found = local_moves(a, b, w, size, gamma, rng)
        k = int(found.max()) + 1 if size else 0
        label = found[label]
        if k == size:
            return label
        x, y = np.minimum(found[a], found[b]), np.maximum(found[a], found[b])
        pair, back = np.unique(x * k + y, return_inverse=True)
        a, b, w, size = pair // k, pair % k, np.bincount(back, w), k


def _shrunk(edges: DataFrame, gamma: float, seed: int) -> DataFrame:
    """``node, community`` after rounds in which the half of the nodes that its hash chooses moves to the neighbouring community of the largest gain."""
    both = edges.where("a <> b").select("a", "b", "w").union(edges.where("a <> b").select("b", "a", "w"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "w"), F.struct(F.col("b").alias("node"), "w"))).alias("e")).select("e.*")
    strength = checkpointed(ends.groupBy("node").agg(F.sum("w").alias("s")))
    total = float(strength.agg(F.sum("s")).first()[0] or 1.0)
    both = checkpointed(both)
    now = checkpointed(strength.select("node", "s", F.col("node").alias("community")))
    for turn in range(ROUNDS):
        volume = now.groupBy("community").agg(F.sum("s").alias("v"))
        links = both.join(now.select(F.col("node").alias("b"), F.col("community").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("l"))
        here = now.select("node", F.col("community").alias("to"), F.lit(0.0).alias("l"))
        options = links.unionByName(here).groupBy("node", "to").agg(F.sum("l").alias("l")).join(volume.withColumnRenamed("community", "to"), "to").join(now, "node")
        rest = F.col("v") - F.when(F.col("to") == F.col("community"), F.col("s")).otherwise(0.0)
        gain = F.col("l") - F.lit(gamma / total) * F.col("s") * rest
        best = options.groupBy("node").agg(F.max(F.struct(gain.alias("g"), (F.col("to") == F.col("community")).alias("stays"), (-F.col("to")).alias("t"))).alias("best"))
        moves = (F.pmod(F.xxhash64("node", F.lit(seed), F.lit(turn)), F.lit(2)) == 0) & F.col("best").isNotNull()
        then = checkpointed(now.join(best, "node", "left").select("node", "s", F.when(moves, -F.col("best.t")).otherwise(F.col("community")).alias("community"), F.col("community").alias("was")))
        changed = not then.where("community <> was").isEmpty()
        released(now)
        now = then
        if not changed:
            break
    released(both)
    released(strength)
    return now.select("node", "community")


def louvain(graph: EdgeList, id_mapper: IDMapper, gamma: float = 1.0, seed: int | None = None) -> DataFrame:
    """``code, community`` of every node; isolated nodes are communities of their own.

    Up to KERNEL_EDGES edges a numpy kernel does all levels. Larger graphs are
    shrunk by Spark rounds to the graph of their communities, until that fits.
    Communities are numbered from 0 by their least code.
    """
    edges = undirected(graph)
    owner = id_mapper.nodes.select("code", F.col("code").alias("node"))
    while True:
        rows = edges.limit(KERNEL_EDGES + 1).toArrow()
        if rows.num_rows <= KERNEL_EDGES:
            break
        before = edges
        part = checkpointed(_shrunk(edges, gamma, seed or 0))
        owner = checkpointed(owner.join(part, "node", "left").select("code", F.coalesce("community", "node").alias("node")))
        a, b = part.toDF("a", "ca"), part.toDF("b", "cb")
        x = before.join(a, "a").join(b, "b")
        edges = checkpointed(x.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        if edges.count() >= rows.num_rows and before.count() == edges.count():
            raise ConfigurationError("the graph's communities do not shrink it to what one machine takes", parameter="resolution", value=gamma)
    a, b, w = rows["a"].to_numpy(), rows["b"].to_numpy(), rows["w"].to_numpy()
    names = np.unique(np.concatenate([a, b]))
    order = np.lexsort((b, a))
    label = kernel(np.searchsorted(names, a[order]), np.searchsorted(names, b[order]), w[order], len(names), gamma, seed)
    spark = id_mapper.nodes.sparkSession
    first = np.full(int(label.max()) + 1 if len(label) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, label, names)
    table = spark.createDataFrame(pd.DataFrame({"node": names, "c": first[label]}), "node long, c long")
    found = owner.join(table, "node", "left").select("code", F.coalesce("c", "node").alias("c"))
    least = found.groupBy("c").agg(F.min("code").alias("least"))
    ranked = least.select("c", (F.row_number().over(Window.orderBy("least")) - 1).cast("long").alias("community"))
    return found.join(ranked, "c").select("code", "community")


def modularity(graph: EdgeList, parts: DataFrame, gamma: float = 1.0) -> float:
    """Modularity of ``code, community`` over the undirected weights."""
    e = undirected(graph)
    x = e.join(parts.select(F.col("code").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("code").alias("b"), F.col("community").alias("cb")), "b")
    ends = x.select("w", F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.sum("w").alias("v"))
    inside, all_ = x.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)), F.sum("w")).first()
    if not all_:
        return 0.0
    return inside / all_ - gamma * (ends.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0) / (4 * all_ * all_)


def coverage(graph: EdgeList, parts: DataFrame) -> float:
    """Share of edges within a community; 0 without edges."""
    p = parts.select("code", "community")
    x = graph.df.join(p.toDF("src", "ca"), "src").join(p.toDF("tgt", "cb"), "tgt")
    return x.agg(F.avg((F.col("ca") == F.col("cb")).cast("double"))).first()[0] or 0.0


def mutual_information(long: DataFrame, first: int, second: int) -> float:
    """Normalised mutual information (arithmetic mean) of two iterations of ``code, iteration, community``."""
    pair = long.where(F.col("iteration").isin(first, second)).groupBy("code").agg(F.max(F.when(F.col("iteration") == first, F.col("community"))).alias("x"), F.max(F.when(F.col("iteration") == second, F.col("community"))).alias("y"))
    counts = pair.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    t = counts.toPandas()
    n = t["n"].sum()
    if not n:
        return 0.0
    px, py = t.groupby("x")["n"].sum() / n, t.groupby("y")["n"].sum() / n
    p = t["n"] / n
    hx, hy = -(px * np.log(px)).sum(), -(py * np.log(py)).sum()
    if hx + hy == 0:
        return 1.0
    return float((p * np.log(p / (t["x"].map(px) * t["y"].map(py)))).sum() / ((hx + hy) / 2))


def consensus(long: DataFrame) -> DataFrame:
    """``code, community_consensus, stability`` of ``code, iteration, community``: each node's most frequent label (the earliest of equals), renumbered without gaps, and its share."""
    votes = long.groupBy("code", "community").agg(F.count("*").alias("n"), F.min("iteration").alias("seen"))
    best = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "seen"))
    runs = F.sum("n").over(Window.partitionBy("code"))
    top = votes.select("code", "community", (F.col("n") / runs).alias("stability"), best.alias("r")).where("r = 1")
    names = top.select("community").distinct().select("community", (F.row_number().over(Window.orderBy("community")) - 1).cast("long").alias("community_consensus"))
    return top.join(names, "community").select("code", "community_consensus", "stability")


def detect_communities(graph: EdgeList, id_mapper: IDMapper, algorithm: str = "louvain", iterations: int = 1, resolution: float = 1.0, min_similarity: float | None = None, random_seed: int | None = None, n_jobs: int = -1) -> DataFrame:
    """``node_id, community_consensus, stability`` and for each iteration its community, modularity and number of communities.

    Iteration i uses random_seed + i. With min_similarity only iterations whose
    mean normalised mutual information with the others reaches it vote (all of
    them if none does). n_jobs means nothing here.
    """
    validate_parameter(algorithm, ["louvain"], "algorithm")
    if iterations < 1:
        raise ValidationError("iterations must be at least 1", field="iterations", value=iterations)
    if resolution <= 0:
        raise ValidationError("resolution must be positive", field="resolution", value=resolution)
    if min_similarity is not None and not 0 <= min_similarity <= 1:
        raise ValidationError("min_similarity lies in [0, 1]", field="min_similarity", value=min_similarity)
    runs = [checkpointed(louvain(graph, id_mapper, resolution, None if random_seed is None else random_seed + i)) for i in range(iterations)]
    long = runs[0].withColumn("iteration", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        long = long.unionByName(r.withColumn("iteration", F.lit(i)))
    votes = long
    if min_similarity is not None and iterations > 1:
        nmi = np.array([[1.0 if i == j else mutual_information(long, i, j) for j in range(iterations)] for i in range(iterations)])
        mean = (nmi.sum(axis=1) - 1) / (iterations - 1)
        chosen = np.flatnonzero(mean >= min_similarity).tolist()
        if not chosen:
            log.warning("no iteration reaches min_similarity; all of them vote")
        votes = long.where(F.col("iteration").isin(chosen or list(range(iterations))))
    out = id_mapper.nodes.select("node_id", "code").join(consensus(votes), "code")
    for i, r in enumerate(runs):
        k = r.select("community").distinct().count()
        out = out.join(r.withColumnRenamed("community", f"community_iter_{i}"), "code").withColumn(f"modularity_iter_{i}", F.lit(modularity(graph, r, resolution))).withColumn(f"num_communities_iter_{i}", F.lit(k))
    return out.drop("code").orderBy("node_id")


def get_community_summary(communities_df: DataFrame, iteration: int | None = None) -> dict[str, Any]:
    """Sizes of the consensus' or one iteration's communities, with modularity and mean stability."""
    column = "community_consensus" if iteration is None else f"community_iter_{iteration}"
    if column not in communities_df.columns:
        raise ValueError(f"iteration {iteration} is not in the results")
    quality = f"modularity_iter_{iteration or 0}"
    sizes = sorted((r[0] for r in communities_df.groupBy(column).count().select("count").collect()), reverse=True)
    mean = communities_df.agg(F.avg("stability")).first()[0] if "stability" in communities_df.columns else None
    first = communities_df.select(quality).first() if quality in communities_df.columns else None
    spread = {"min": min(sizes, default=0), "max": max(sizes, default=0), "mean": float(np.mean(sizes)) if sizes else 0.0, "median": float(np.median(sizes)) if sizes else 0.0, "std": float(np.std(sizes)) if sizes else 0.0}
    return {"num_communities": len(sizes), "modularity": first[0] if first else None, "avg_stability": mean, "community_sizes": sizes, "size_distribution": spread, "total_nodes": sum(sizes)}


def identify_stable_communities(communities_df: DataFrame, min_stability: float = 0.8, min_size: int = 3) -> DataFrame:
    """Rows of at least min_stability whose community has at least min_size such rows."""
    stable = communities_df.where(F.col("stability") >= min_stability)
    large = stable.groupBy("community_consensus").count().where(F.col("count") >= min_size).select("community_consensus")
    return stable.join(large, "community_consensus", "left_semi").select(*communities_df.columns)
