"""Small networks with known answers."""

import math
from datetime import datetime

import numpy as np
import pytest

from netspark.edges import EdgeList, IDMapper, from_frame
from netspark.errors import ComputationError, ConvergenceError, ValidationError
from netspark.functions.stats import poisson_upper
from netspark.functions.weights import transformed
from netspark.operators import backbone, categories, centrality as centrality_module, communities, construct, embed, evaluate, filters, project, propagate, reduce, seeds, temporal, text, validate
from netspark.operators.centrality import centrality, compare_centrality_metrics, extract_centrality, identify_central_nodes
from netspark.plans import pipelines
from netspark.sources.export import export_graph, export_reduced_graph, get_export_info
from netspark.sources.load import read_edgelist_parquet, write_edgelist_parquet
from netspark.streaming.slices import stream_slices


def frame(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "source_id string, target_id string, weight double")


def edges(df):
    return {(r["source_id"], r["target_id"]): r["weight"] for r in df.collect()}


@pytest.fixture(scope="module")
def triangles(spark):
    return from_frame(frame(spark, [("A", "B", 1), ("B", "C", 1), ("A", "C", 1), ("D", "E", 1), ("E", "F", 1), ("D", "F", 1), ("C", "D", 1)]))


def test_counted_edges_and_codes(spark):
    df = spark.createDataFrame([("A", "B")] * 2 + [("B", "C")] * 3 + [(None, "C")], "source string, target string")
    el, mapper = construct.build_edgelist_from_frame(df)
    assert edges(el.frame(mapper)) == {("A", "B"): 2.0, ("B", "C"): 3.0}
    assert {r["node_id"]: r["code"] for r in mapper.nodes.collect()} == {"A": 0, "B": 1, "C": 2}
    assert construct.get_graph_info(el, mapper)["is_connected"] and construct.validate_graph_construction(el, mapper, 3, 2)


def test_overlapping_sides_are_an_error(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    with pytest.raises(ValidationError):
        construct.build_edgelist_from_frame(df, bipartite=True)
    with pytest.raises(ValidationError):
        construct.build_edgelist_from_frame(df, target_col="nowhere")


def test_edge_lists_survive_parquet(spark, triangles, tmp_path):
    meta = write_edgelist_parquet(triangles[0], str(tmp_path / "e.parquet"))
    again = read_edgelist_parquet(str(tmp_path / "e.parquet"), meta, spark)
    assert edges(again.frame(triangles[1])) == edges(triangles[0].frame(triangles[1]))


def test_mappers_round_trip(spark):
    m = IDMapper.from_originals(["x", "y"], spark)
    assert IDMapper.from_dict(m.to_dict(), spark).to_dict() == m.to_dict()
    assert m.get_internal_batch(["y", "x"]) == [1, 0] and "x" in m and 1 in m and len(m) == 2
    with pytest.raises(KeyError):
        m.get_internal("z")
    with pytest.raises(ValueError):
        m.set_bipartite_partitions(["x"], ["x"])


def test_projections(spark):
    b = frame(spark, [("u1", "i1", 1), ("u1", "i2", 1), ("u1", "i3", 1), ("u2", "i1", 1), ("u2", "i2", 1), ("u3", "i1", 1)])
    jaccard = edges(project.project_bipartite(b, weight_method="jaccard"))
    assert jaccard[("u1", "u2")] == pytest.approx(2 / 3) and jaccard[("u1", "u3")] == pytest.approx(1 / 3)
    el, mapper = project.project_bipartite(*from_frame(b), projection_mode="target")  # the least node, i1, makes the items sources
    assert mapper.size() == 3 and edges(el.frame(mapper))[("u1", "u2")] == 2.0
    with pytest.raises(Exception, match="bipartite"):
        project.project_bipartite(*from_frame(frame(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)])))


def test_later_sharers_point_to_earlier_ones(spark):
    df = spark.createDataFrame([("Alice", "X", "2024-01-01 09:00:00"), ("Bob", "X", "2024-01-01 11:00:00"), ("Bob", "X", "2024-01-01 08:00:00")], "user string, item string, timestamp string")
    out = project.temporal_bipartite_to_unipartite(df, "user", "item", "timestamp", output_format="frame")
    assert edges(out) == {("Bob", "Alice"): 1.0}


def test_disparity_on_a_path(spark):
    out = backbone.apply_backbone(frame(spark, [("A", "B", 2), ("B", "C", 3)]), method="disparity", include_scores=True).collect()
    assert {r["source_id"]: round(r["alpha_score"], 9) for r in out} == {"A": 0.6, "B": 0.4}


def test_ieee_results_where_one_node_owns_all(spark):
    out = backbone.noise_corrected(frame(spark, [("A", "A", 1)])).first()
    assert out["score"] is not None and (math.isnan(out["sdev_cij"]) or math.isinf(out["sdev_cij"]) or out["sdev_cij"] >= 0)
    with pytest.raises(ComputationError):
        backbone.noise_corrected(frame(spark, [("A", "B", 0)]))


def test_poisson_tail_against_direct_sums():
    for mu in (1e-6, 0.3, 4.0, 80.0):
        for k in (0, 1, 2, 7, 40, 120):
            below = math.fsum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(k))
            assert poisson_upper(np.array([float(k)]), np.array([mu]))[0] == pytest.approx(max(0.0, 1 - below), abs=1e-10)


def test_filters(spark, triangles):
    ring = frame(spark, [("0", "1", 1), ("1", "2", 5), ("2", "3", 3), ("3", "0", 2)])
    assert set(edges(filters.filter_graph(ring, None, {"min_weight": 3}))) == {("1", "2"), ("2", "3")}
    assert len(edges(filters.filter_graph(ring, None, {"min_weight": 5}, protected_nodes=["0"]))) == 3
    with pytest.raises(ComputationError):
        filters.filter_graph(ring, None, {"min_weight": 50})
    small, names = filters.filter_by_seed_proximity(*triangles, ["A"], hops=1)
    assert set(edges(small.frame(names))) == {("A", "B"), ("B", "C"), ("A", "C")}
    near, names = filters.filter_by_seed_proximity(*triangles, ["A"], "lte")
    assert {r[0] for r in names.nodes.select("node_id").collect()} >= {"A", "B", "C"}


def test_centralities(spark, triangles):
    out = {r["node_id"]: r for r in extract_centrality(*triangles, metrics=["degree", "betweenness", "closeness"]).collect()}
    assert out["C"]["degree_centrality"] == pytest.approx(3 / 5) and out["C"]["betweenness_centrality"] == pytest.approx(6 / 10) and out["A"]["betweenness_centrality"] == 0
    assert out["A"]["closeness_centrality"] == pytest.approx((2 + 1 / 2 + 2 / 3) / 5)
    df = extract_centrality(*triangles, metrics=["degree", "closeness"])
    assert identify_central_nodes(df, "degree_centrality", 2) == ["C", "D"]
    assert compare_centrality_metrics(df, "degree_centrality", "closeness_centrality")["spearman"] == pytest.approx(1)
    with pytest.raises(ValidationError):
        centrality(frame(spark, [("a", "b", 1)]), "fame")


def test_communities(spark, triangles):
    out = communities.detect_communities(*triangles, iterations=3, random_seed=1)
    by = {}
    for r in out.collect():
        by.setdefault(r["community_consensus"], set()).add(r["node_id"])
        assert r["stability"] == 1.0 and r["modularity_iter_0"] == pytest.approx(6 / 7 - 0.5)
    assert sorted(map(sorted, by.values())) == [["A", "B", "C"], ["D", "E", "F"]]
    assert communities.get_community_summary(out)["community_sizes"] == [3, 3]
    assert communities.identify_stable_communities(out, min_size=4).count() == 0
    el, mapper = triangles
    assert communities.coverage(el, communities.louvain(el, mapper, seed=1)) == pytest.approx(6 / 7)


def test_reductions(spark, triangles, tmp_path):
    glp = propagate.guided_label_propagation(*triangles, {"A": "l", "F": "r"}, ["l", "r"])
    small, names, attributes = reduce.reduce_by_grouping(*triangles, glp_results=glp, random_seed=1)
    rows = {r["member_ids"]: r for r in attributes.collect()}
    assert set(rows) == {"A|B|C", "D|E|F"} and rows["A|B|C"]["dominant_label"] == "l" and rows["A|B|C"]["seed_fraction"] == pytest.approx(1 / 3)
    assert sorted(edges(small.frame(names)).values()) == [1.0, 3.0, 3.0]
    small, names, _ = reduce.reduce_by_sampling(*triangles, target_nodes=4, random_seed=2)
    assert names.size() == 4
    small, names, _ = reduce.reduce_by_influence(*triangles, backbone_method="weight", target_nodes=2)
    assert set(edges(small.frame(names))) == {("C", "D")}
    path = export_reduced_graph(*triangles, str(tmp_path / "g"), "grouping", random_seed=1)
    assert path.read_text().count("<node ") == 2


def test_exports(spark, triangles, tmp_path):
    import xml.etree.ElementTree as ET

    meta = spark.createDataFrame([("A", "x & y")], "node_id string, note string")
    export_graph(*triangles, str(tmp_path / "g"), "gexf", meta)
    export_graph(*triangles, str(tmp_path / "g"), "graphml", meta, ["degree"])
    gexf, graphml = ET.parse(tmp_path / "g.gexf").getroot(), ET.parse(tmp_path / "g.graphml").getroot()
    assert len(gexf.findall(".//{*}node")) == 6 and len(gexf.findall(".//{*}edge")) == 7 and gexf.find(".//{*}attvalue").get("value") == "x & y"
    assert len(graphml.findall(".//{*}edge")) == 7 and len(graphml.findall("{*}key")) == 3
    export_graph(*triangles, str(tmp_path / "e"), "edgelist", meta)
    export_graph(*triangles, str(tmp_path / "p"), "parquet", overwrite=True)
    assert spark.read.csv(str(tmp_path / "e.csv"), header=True).columns == ["source", "target", "weight", "source_note", "target_note"]
    assert spark.read.parquet(str(tmp_path / "p_edges.parquet")).count() == 7
    assert get_export_info(*triangles, meta)["missing_metadata_nodes"] == 5


def test_propagation_on_a_triangle(spark):
    g = from_frame(frame(spark, [("A", "B", 1), ("B", "C", 1), ("A", "C", 1)]))
    rows = {r["node_id"]: r for r in propagate.guided_label_propagation(*g, {"A": "left", "C": "right"}, ["left", "right"], alpha=0.5).collect()}
    assert rows["A"]["dominant_label"] == "left" and rows["C"]["dominant_label"] == "right" and rows["B"]["left_prob"] == pytest.approx(0.5)
    assert rows["A"]["left_prob"] == pytest.approx(0.75, abs=1e-5) and rows["A"]["is_seed"] and not rows["B"]["is_seed"]
    with pytest.raises(ConvergenceError):
        propagate.guided_label_propagation(*g, {"A": "left", "C": "right"}, ["left", "right"], alpha=0.99, max_iterations=3)


def test_kernel_and_joins_agree(spark, triangles, monkeypatch):
    seeds_ = {"A": "l", "F": "r"}
    one = {r["node_id"]: r["l_prob"] for r in propagate.guided_label_propagation(*triangles, seeds_, ["l", "r"], alpha=0.6).collect()}
    monkeypatch.setattr(propagate, "KERNEL_ARCS", 2)
    two = {r["node_id"]: r["l_prob"] for r in propagate.guided_label_propagation(*triangles, seeds_, ["l", "r"], alpha=0.6).collect()}
    assert one == pytest.approx(two, abs=1e-5)


def test_directed_graphs_give_both_directions(spark):
    g = from_frame(frame(spark, [("A", "B", 1), ("B", "C", 1)]), directed=True)
    out, in_ = propagate.guided_label_propagation(*g, {"A": "x", "C": "y"}, ["x", "y"])
    o, i = ({r["node_id"]: r for r in df.collect()} for df in (out, in_))
    assert o["B"]["dominant_label"] == "y" and i["B"]["dominant_label"] == "x"
    assert evaluate.compare_directional_results(out, in_, ["x", "y"])["agreement_rate"] == pytest.approx(2 / 3)
    audience = {r["node_id"]: r for r in propagate.audience_composition_pass(*g, in_, ["x", "y"]).collect()}
    assert audience["A"]["x_prob"] == pytest.approx(0.5) and audience["B"]["x_prob"] == pytest.approx(i["A"]["x_prob"])


def test_validation(spark):
    rows = [(f"{s}{i}", f"{s}{j}", 1) for s in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.5)]
    g = from_frame(frame(spark, rows))
    known = {f"{s}{i}": s for s in "ab" for i in range(6)}
    out = validate.train_test_split_validation(*g, known, ["a", "b"], test_size=0.34, random_seed=1)
    assert out["accuracy"] == 1.0 and out["macro_f1"] == 1.0
    assert validate.metrics_of({("a", "a"): 3, ("a", "noise"): 1}, ["a", "b"])["noise_errors"] == 1
    assert seeds.check_seed_coverage(g[1], {"a0": "a", "zz": "b"})["train"]["missing"] == 1


def test_slices_and_statistics(spark):
    rows = [("a", "b", f"2024-01-0{d} 10:00:00") for d in (1, 1, 2, 4)]
    df = spark.createDataFrame(rows, "source string, target string, timestamp string")
    g = temporal.create_temporal_slices(df)
    assert [d.strftime("%d %H:%M") for d in g.dates] == ["01 23:59", "02 23:59", "03 23:59", "04 23:59"]
    assert [el.number_of_edges() for _, el, _ in g] == [1, 1, 0, 1]
    stats = {r["node_id"]: r for r in temporal.calculate_temporal_statistics(temporal.extract_temporal_metrics(g, ["degree"]), ["mean", "trend"]).collect()}
    assert stats["a"]["degree_mean"] == 0.75 and stats["a"]["degree_trend"] == pytest.approx(-0.1)
    c = spark.createDataFrame([("d", "A", "A", 10.0), ("d", "A", "B", 5.0), ("d", "B", "B", 11.0)], "date string, category_a string, category_b string, connection_strength double")
    assert categories.calculate_category_segregation_index(c).first()["segregation_index"] == pytest.approx(21 / 26)


def test_stream_of_edges(spark, tmp_path):
    rows = [("a", "b", datetime(2024, 1, d, 5)) for d in (1, 1, 2)]
    df = spark.createDataFrame(rows, "source string, target string, timestamp timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_slices(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("slices").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["weight"] for r in spark.table("slices").collect()) == [1.0, 2.0]
    assert sorted(r["weight"] for r in stream_slices(df).collect()) == [1.0, 2.0]


def test_posts(spark):
    df = spark.createDataFrame([("s", "Read https://WWW.Example.com/a?utm_source=x&id=3, and https://youtu.be/abc123?t=4!", "t")], "sender string, post string, datetime string")
    assert {r["url"] for r in text.extract_urls(df).collect()} == {"https://www.example.com/a?id=3", "https://youtube.com/watch?v=abc123"}
    assert {r["domain"] for r in text.extract_domains(df).collect()} == {"example.com", "youtube.com"}
    long = spark.createDataFrame([("s", "deep label propagation of the deep label", "t"), ("r", None, "t")], "sender string, post string, datetime string")
    assert [r["keyword"] for r in text.extract_keywords(long, method="rake", stop_words=["of", "the"], top_n=1).collect()] == ["deep label propagation"]


def test_similar_senders(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "sender string, e array<double>").selectExpr("*", "'' AS post")
    rows = {(r["source"], r["target"]) for r in embed.extract_embedding_similarity_edgelist(v, embedding_col="e", k=1, mutual=True).collect()}
    assert rows == {("a", "b")}


def test_pipeline_stages_in_all_modes(spark):
    rows = [(f"u{i}", f"x{j}", datetime(2024, 1, 1 + (i * 7 + j) % 20)) for i in range(12) for j in range(12) if (i + j) % 3]
    df = spark.createDataFrame(rows, "user string, item string, at timestamp")
    found = []
    for mode in ("fast", "balanced", "low"):
        out = pipelines.run_canonical_pipeline(df, source_col="user", target_col="item", timestamp_col="at", bipartite_target_fraction=0.8, memory_mode=mode, keep_intermediates=True)
        assert [s.name for s in out.stage_stats][0] == "build_edgelist_from_frame" and isinstance(out.edgelist, EdgeList) and len(out.intermediates) == 4
        found.append({k: round(v, 9) for k, v in edges(out.edgelist.frame(out.id_mapper)).items()})
    assert found[0] == found[1] == found[2]
    kept = pipelines.run_canonical_pipeline(df, source_col="user", target_col="item", timestamp_col="at", bipartite_target_fraction=0.8, memory_mode="low")
    assert {k: round(v, 9) for k, v in edges(kept.edgelist.frame(kept.id_mapper)).items()} == found[0]


def test_a_transition_reads_its_input_once(spark, tmp_path):
    """The plans of what follows from_frame() hold no scan of the tables it was made of."""
    rows = [(f"u{i}", f"k{(i * j) % 9}") for i in range(30) for j in range(1, 5)]
    spark.createDataFrame(rows, "p string, s string").write.parquet(f"{tmp_path}/base.parquet")
    el, mapper = from_frame(project.projected_pairs(spark.read.parquet(f"{tmp_path}/base.parquet"), "p", "s"))
    for df in (el.df, mapper.nodes, propagate.transition(el, "out_degree")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "base.parquet" not in plan and plan.count("FileScan") <= 2


def test_float_transforms_that_compare(spark):
    df = spark.createDataFrame([(0.5,), (3.0,)], "w double")
    assert [r[0] for r in df.select(transformed(df["w"], lambda w: min(w, 1.0))).collect()] == [0.5, 1.0]
    assert [r[0] for r in df.select(transformed(df["w"], lambda w: w if w > 1 else 0.0)).collect()] == [0.0, 3.0]


def test_hot_keys_are_split(spark, monkeypatch):
    """One item that all share, in parts of 5, gives the pairs of the plain join."""
    rows = [(f"u{i:02}", "hot", i % 7) for i in range(23)] + [(f"u{i:02}", f"k{i % 4}", i) for i in range(23)]
    df = spark.createDataFrame(rows, "source string, target string, t int").selectExpr("source", "target", "timestamp_seconds(t) AS t")
    whole = [edges(project.projected_pairs(df, "source", "target")), edges(project.temporal_pairs(df, "target", "source", "t"))]
    monkeypatch.setattr(project, "PART", 5)
    assert [edges(project.projected_pairs(df, "source", "target")), edges(project.temporal_pairs(df, "target", "source", "t"))] == whole
    assert len(whole[0]) == 23 * 22 // 2


def test_propagation_by_joins_equals_the_kernel(spark, triangles, monkeypatch):
    """Both routes, with the rounds' snapshots and the same number of rounds."""
    el, mapper = triangles
    runs = []
    for limit in (propagate.KERNEL_ARCS, 0):
        monkeypatch.setattr(propagate, "KERNEL_ARCS", limit)
        out, rounds = propagate.guided_label_propagation(el, mapper, {"A": "x", "F": "y"}, ["x", "y"], convergence_threshold=1e-4, return_snapshots=True)
        runs.append(({r["node_id"]: round(r["x_prob"], 9) for r in out.collect()}, len(rounds), {r["node"]: [round(x, 9) for x in r["f"]] for r in rounds[2].collect()}))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("step", ["pagerank", "eigenvector", "katz"])
def test_power_iteration_by_joins_equals_the_kernel(spark, monkeypatch, step):
    """Also nodes without out-arcs, isolated ones, and a restart."""
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "d", 0.5), ("e", "a", 3.0)], "source_id string, target_id string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node_id string")
    restart = spark.createDataFrame([("a", 0.25), ("d", 0.75)], "node_id string, s double")
    for options in ({}, {"restart": restart, "total_change": True}) if step == "pagerank" else ({},):
        runs = []
        for limit in (centrality_module.KERNEL_ARCS, 0):
            monkeypatch.setattr(centrality_module, "KERNEL_ARCS", limit)
            out = centrality_module.power_iteration(e, nodes, step, True, 6, 1e-3, **options)
            runs.append({r["node_id"]: round(r["value"], 12) for r in out.collect()})
        assert runs[0] == runs[1] and len(runs[0]) == 6
        if step == "pagerank":
            assert sum(runs[0].values()) == pytest.approx(1)
        monkeypatch.undo()


def test_benjamini_hochberg_against_sorting(spark):
    rng = np.random.default_rng(4)
    for p in (np.concatenate([rng.random(200) ** 6, [0.0, 0.0, 1.0, 1e-300]]), np.full(5, 0.5), rng.random(50) * 1e-9):
        order = np.sort(p)
        passed = order[order <= np.arange(1, len(p) + 1) / len(p) * 0.05]
        kept = {round(r["p"], 300): r["kept"] for r in backbone.benjamini_hochberg(spark.createDataFrame([(float(x),) for x in p], "p double"), "p", 0.05).collect()}
        assert all(k == (len(passed) > 0 and x <= passed.max()) for x, k in kept.items())
