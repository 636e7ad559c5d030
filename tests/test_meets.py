"""Sums over pairs that meet in shared ids, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from netspark.edges import from_frame
from netspark.operators import backbone, centrality, embed, factor, meets, project, propagate, reduce


def edges(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def shares_of_a(df):
    return {r["node_id"]: r["a_prob"] for r in df.collect()}


@pytest.fixture(scope="module")
def shares(spark):
    rng = random.Random(1)
    pairs = sorted({(f"u{rng.randrange(150)}", f"k{rng.choice([rng.randrange(3), rng.randrange(40)])}") for _ in range(1500)})
    rows = [(u, k, rng.choice([None, *range(300)]), rng.choice([None, 1.0, 2.5, 7.0])) for u, k in pairs]
    return rows, spark.createDataFrame(rows, "source string, target string, t int, w double").selectExpr("source", "target", "timestamp_seconds(t * 4000) AS t", "w")


@pytest.mark.parametrize(("tiled", "part"), [(True, 1024), (False, 1024), (False, 5)])
def test_tiles_and_lists_give_the_pairs_of_brute_force(shares, monkeypatch, tiled, part):
    rows, df = shares
    monkeypatch.setattr(meets, "WIDE", 50)
    monkeypatch.setattr(project, "summed_pairs", lambda *a, **k: meets.summed_pairs(*a, **k | {"tiled": tiled, "part": part}))
    by = defaultdict(list)
    for u, k, t, w in rows:
        by[k].append((u, t, w))
    count, later, decayed = Counter(), Counter(), {}
    for of in by.values():
        of.sort(key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        for i, (a, ta, wa) in enumerate(of):
            for b, tb, wb in of[i + 1 :]:
                count[min(a, b), max(a, b)] += 1
                later[a, b] += 1
                decayed.setdefault((a, b), None)
                if None not in (ta, tb, wa, wb):
                    decayed[a, b] = (decayed[a, b] or 0) + (wa + wb) / 2 / (1 + abs(ta - tb) * 4000 / 86400)
    assert edges(project.projected_pairs(df, "source", "target")) == count
    assert edges(project.temporal_pairs(df, "target", "source", "t")) == later
    found = edges(project.temporal_pairs(df, "target", "source", "t", "w", time_decay=True))
    assert {p: None if x is None else round(x, 9) for p, x in found.items()} == {p: None if x is None else round(x, 9) for p, x in decayed.items()}


def test_pairs_are_added_up_before_they_are_sent(shares):
    """No plan has an aggregation or an exchange over pairs: tiles give final rows, and lists send packed ranges."""
    rows, df = shares
    for out in (project.projected_pairs(df, "source", "target"), project.temporal_pairs(df, "target", "source", "t")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "keys=[source_id" not in plan and "hashpartitioning(source_id" not in plan and plan.count("MapInArrow") == 1


def test_iterations_along_the_factor_equal_those_along_pairs(spark, shares, monkeypatch):
    """Propagation, power iterations and fires, by joins and on the driver; edges of the factored graph can't even be read."""
    _, df = shares
    plain, names = from_frame(project.projected_pairs(df, "source", "target"))
    graph, mapper = project.projected_graph(df, "source", "target")
    assert sorted(names.nodes.collect()) == sorted(mapper.nodes.collect())
    assert sorted(plain.df.collect()) == sorted(graph.df.collect())
    burnt = [sorted(r[0] for r in reduce.reduce_by_sampling(plain, names, target_nodes=20, random_seed=3)[1].nodes.select("node_id").collect())]
    for g in (plain, graph):
        monkeypatch.setattr(reduce, "FIRE_EDGES", 10)
        burnt.append(sorted(r[0] for r in reduce.reduce_by_sampling(g, mapper, target_nodes=20, random_seed=3)[1].nodes.select("node_id").collect()))
    assert burnt[0] == burnt[1] == burnt[2]
    unread = graph.with_df(graph.df.withColumn("weight", F.raise_error(F.lit("pairs are read")).cast("double")), factor=graph.factor)
    seeds = {"u1": "a", "u2": "b"}
    ids = mapper.nodes.select(F.col("code").alias("node_id"))
    whole = shares_of_a(propagate.guided_label_propagation(plain, names, seeds, ["a", "b"], max_iterations=30, convergence_threshold=1e-3))
    for limit in (factor.KERNEL_ROWS, 0):
        for module in (propagate, centrality):
            monkeypatch.setattr(module, "KERNEL_ROWS", limit)
        found = shares_of_a(propagate.guided_label_propagation(unread, mapper, seeds, ["a", "b"], max_iterations=30, convergence_threshold=1e-3))
        assert found == pytest.approx(whole, abs=1e-9)
        for step in ("pagerank", "eigenvector", "katz"):
            want = {r[0]: r[1] for r in centrality.power_iteration(plain.frame(), ids, step, iterations=3).collect()}
            graph_ = graph if step == "katz" else unread
            assert {r[0]: r[1] for r in centrality.power_iteration(graph_, ids, step, iterations=3).collect()} == pytest.approx(want, rel=1e-9)


def test_neighbours_that_single_precision_cannot_tell_apart(spark):
    """The k nearest in double, of vectors that differ by less than a float can tell, over several blocks."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(12, 6)), 20, axis=0) + 1e-6 * rng.normal(size=(240, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = np.einsum("id,jd->ij", x, x) - 2 * np.eye(len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {(r[0], r[1]) for r in embed.nearest(df, 3, 0.5, 64).collect()}
    by_row = [set(np.argsort(-s, kind="stable")[:3].tolist()) for s in sims]
    # Doubles added up in another order may differ in the last digits.
    assert len(found) == 3 * len(x) and all(j in by_row[i] or abs(sims[i, j] - np.sort(sims[i])[-3]) < 1e-15 for i, j in found)


def test_the_first_rows_are_found_in_ranges(spark, monkeypatch):
    """Beyond TOP_ROWS no task orders all of them; ties are by ids."""
    rows = [(f"a{i % 40:02}", f"b{i // 40:02}", float(i % 7)) for i in range(1200)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, weight double")
    monkeypatch.setattr(backbone, "TOP_ROWS", 50)
    kept = sorted((-r["weight"], r["source_id"], r["target_id"]) for r in backbone.weight_threshold(df, target_edges=437).where("kept").collect())
    assert kept == sorted((-w, s, t) for s, t, w in rows)[:437]
