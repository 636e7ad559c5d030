"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows.

Real numbers are rounded to six digits on both sides, since sums depend on
their order. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, from_frame
from netspark.functions.urls import TRACKING
from netspark.functions.weights import log1p_transform, tanh_transform, transformed, winsorize_transform
from netspark.operators import backbone, categories, centrality, communities, construct, embed, evaluate, filters, project, propagate, reduce, seeds, temporal, text, validate, validators
from netspark.operators.components import connected_components, giant_component
from netspark.plans import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function under its name, with the SQL of the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """df with its real numbers rounded."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Networks that the queries share, and their SQL.


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Rows supplier -> part with quantity and time."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_quantity").alias("weight"), F.col("l_shipdate").alias("time"))


TRADE = "trade AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_quantity AS weight, l_shipdate AS time FROM lineitem)"


def summed(spark: SparkSession, d: str) -> DataFrame:
    """Edges supplier -> part with summed quantity."""
    return trade(spark, d).groupBy(F.col("source").alias("source_id"), F.col("target").alias("target_id")).agg(F.sum("weight").alias("weight"))


SUMMED = f"{TRADE}, e AS (SELECT source AS source_id, target AS target_id, sum(weight) AS weight FROM trade GROUP BY ALL)"


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows user -> key of events."""
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("target"), F.col("value").alias("weight"), "ts", "event_type", "event_id")


SHARES = "shares AS (SELECT 'u' || user_id AS source, 'k' || regexp_extract(props, '[0-9]+') AS target, value AS weight, ts, event_type, event_id FROM events)"
#: Users by shared keys: source_id < target_id.
PEERS = f"{SHARES}, sp AS (SELECT DISTINCT source AS p, target AS s FROM shares), e AS (SELECT a.p AS source_id, b.p AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM sp a JOIN sp b ON a.s = b.s AND a.p < b.p GROUP BY ALL)"


def peers(spark: SparkSession, d: str) -> DataFrame:
    x = shares(spark, d)
    return project.projected_pairs(x, "source", "target", "count")


def peer_graph(spark: SparkSession, d: str) -> tuple[EdgeList, IDMapper]:
    """The graph of peers(), whose edges are made when they are read."""
    return project.projected_graph(shares(spark, d), "source", "target")


def answers(spark: SparkSession, d: str) -> tuple[EdgeList, IDMapper]:
    """Directed graph user -> key of summed values."""
    x = shares(spark, d)
    return from_frame(x.groupBy(F.col("source").alias("source_id"), F.col("target").alias("target_id")).agg(F.sum("weight").alias("weight")), directed=True)


ANSWERS = f"{SHARES}, e AS (SELECT source AS source_id, target AS target_id, sum(weight) AS weight FROM shares GROUP BY ALL)"


# Construction.


@query(f"WITH {TRADE} SELECT source, target, CAST(count(*) AS DOUBLE) AS weight FROM trade GROUP BY ALL")
def edges_auto_weight(spark: SparkSession, d: str) -> DataFrame:
    return construct.process_edges(trade(spark, d).select("source", "target"), "source", "target", None, True, True, False)


@query(f"WITH {TRADE} SELECT source, target, round(sum(weight), 6) AS weight FROM trade GROUP BY ALL")
def edges_weight_sum(spark: SparkSession, d: str) -> DataFrame:
    return r6(construct.process_edges(trade(spark, d), "source", "target", "weight", False, True, False))


@query(f"WITH {TRADE} SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY weight, time) AS r FROM trade) WHERE r = 1")
def edges_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return construct.process_edges(trade(spark, d), "source", "target", "weight", False, True, True, ["weight", "time"]).select("source", "target", "weight")


@query("SELECT l_suppkey AS source, l_partkey AS target, CAST(count(*) AS DOUBLE) AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL")
def edges_no_self_loops(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return construct.process_edges(x, "source", "target", None, True, False, False)


@query("WITH x AS (SELECT s_suppkey AS source, s_nationkey * 8 AS target FROM supplier), b AS (SELECT source AS x FROM x INTERSECT SELECT target FROM x) SELECT source, target, CAST(count(*) AS BIGINT) AS n FROM x WHERE source NOT IN (SELECT x FROM b) AND target NOT IN (SELECT x FROM b) GROUP BY ALL")
def bipartite_overlap_drop(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and nations numbered so that some numbers are on both sides."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") * 8).alias("target"))
    return construct.apply_bipartite_overlap_policy(x, "source", "target", "drop").groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {SHARES}, g AS (SELECT source FROM shares GROUP BY 1 HAVING count(*) >= 60), h AS (SELECT target FROM shares GROUP BY 1 HAVING count(*) >= 95) SELECT source, target, CAST(count(*) AS BIGINT) AS n FROM shares WHERE source IN (SELECT source FROM g) AND target IN (SELECT target FROM h) GROUP BY ALL")
def min_degree_filter(spark: SparkSession, d: str) -> DataFrame:
    return construct.apply_min_degree_filter(shares(spark, d), "source", "target", 60, 95).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(f"WITH {TRADE} SELECT node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS BIGINT) AS code FROM (SELECT source AS node_id FROM trade UNION SELECT target FROM trade)")
def id_mapping_codes(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = construct.build_edgelist_from_frame(trade(spark, d).select("source", "target"))
    return mapper.nodes.select("node_id", "code")


@query(f"WITH {TRADE}, c AS (SELECT source AS s, target AS t, CAST(count(*) AS DOUBLE) AS weight FROM trade GROUP BY ALL), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS code FROM (SELECT s AS id FROM c UNION SELECT t FROM c)) SELECT CAST(a.code AS BIGINT) AS src, CAST(b.code AS BIGINT) AS tgt, weight FROM c JOIN n a ON a.id = s JOIN n b ON b.id = t")
def edgelist_codes(spark: SparkSession, d: str) -> DataFrame:
    return construct.build_edgelist_from_frame(trade(spark, d).select("source", "target"), bipartite=True)[0].df


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count(l_suppkey) AS BIGINT) AS null_source, CAST(count(*) - count(l_partkey) AS BIGINT) AS null_target, CAST(count(*) FILTER (l_suppkey = l_partkey) AS BIGINT) AS self_loops, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) AS BIGINT) AS duplicates, CAST(count(*) - count(l_quantity) AS BIGINT) AS null_weight, CAST(count(*) FILTER (l_quantity < 0) AS BIGINT) AS negative_weight FROM lineitem")
def edge_validation_report(spark: SparkSession, d: str) -> DataFrame:
    return validators.edge_report(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


@query(f"WITH {ANSWERS}, x AS (SELECT source_id, target_id, weight FROM e UNION ALL SELECT 'stat', target_id, 1.0 FROM (SELECT DISTINCT target_id FROM e)) SELECT source_id, target_id, round(sum(weight), 6) AS weight FROM x GROUP BY ALL")
def edgelist_attach(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = answers(spark, d)
    extra = mapper.nodes.where("node_id LIKE 'k%'").select(F.lit("stat").alias("source_id"), F.col("node_id").alias("target_id"), F.lit(1.0).alias("weight"))
    more, mapper = el.attach(extra, mapper)
    return r6(more.frame(mapper))


# Projection.

_PAIRS = f"WITH {TRADE}, sp AS (SELECT DISTINCT source AS p, target AS s FROM trade), c AS (SELECT a.p AS source_id, b.p AS target_id, count(*) AS n FROM sp a JOIN sp b ON a.s = b.s AND a.p < b.p GROUP BY ALL), g AS (SELECT p, count(*) AS d FROM sp GROUP BY 1)"


@query(_PAIRS + " SELECT source_id, target_id, CAST(n AS DOUBLE) AS weight FROM c")
def project_count(spark: SparkSession, d: str) -> DataFrame:
    return project.project_bipartite(summed(spark, d))


@query(_PAIRS + " SELECT source_id, target_id, round(n / (x.d + y.d - n), 6) AS weight FROM c JOIN g x ON x.p = source_id JOIN g y ON y.p = target_id")
def project_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return r6(project.project_bipartite(summed(spark, d), weight_method="jaccard"))


@query(_PAIRS + " SELECT source_id, target_id, round(n / least(x.d, y.d), 6) AS weight FROM c JOIN g x ON x.p = source_id JOIN g y ON y.p = target_id")
def project_overlap(spark: SparkSession, d: str) -> DataFrame:
    return r6(project.project_bipartite(summed(spark, d), weight_method="overlap"))


@query(f"WITH {SHARES}, sp AS (SELECT DISTINCT target AS p, source AS s FROM shares) SELECT a.p AS source_id, b.p AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM sp a JOIN sp b ON a.s = b.s AND a.p < b.p GROUP BY ALL")
def project_target_side(spark: SparkSession, d: str) -> DataFrame:
    x = shares(spark, d).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    return project.project_bipartite(x, projection_mode="target")


_TEMPORAL = f"WITH {SHARES}, o AS (SELECT target AS i, source AS p, weight AS w, ts AS t, row_number() OVER (PARTITION BY target, source ORDER BY ts DESC, source, weight) AS k FROM shares), r AS (SELECT i, p, w, t, row_number() OVER (PARTITION BY i ORDER BY t DESC, p) AS k FROM o WHERE k = 1)"


@query(_TEMPORAL + " SELECT a.p AS source_id, b.p AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM r a JOIN r b ON a.i = b.i AND a.k < b.k AND a.p <> b.p GROUP BY ALL")
def temporal_projection(spark: SparkSession, d: str) -> DataFrame:
    return project.temporal_bipartite_to_unipartite(shares(spark, d), timestamp_col="ts", output_format="frame")


@query(_TEMPORAL + " SELECT a.p AS source_id, b.p AS target_id, round(sum((a.w + b.w) / 2 / (1 + floor(abs(epoch_us(a.t) - epoch_us(b.t)) / 1000000) / 86400)), 6) AS weight FROM r a JOIN r b ON a.i = b.i AND a.k < b.k AND a.p <> b.p GROUP BY ALL")
def temporal_projection_decay(spark: SparkSession, d: str) -> DataFrame:
    return r6(project.temporal_bipartite_to_unipartite(shares(spark, d), timestamp_col="ts", weight_col="weight", time_decay=True, output_format="frame"))


# Backbones.

_STRENGTH = "st AS (SELECT id, sum(o) AS o, sum(i) AS i, sum(no) AS no, sum(ni) AS ni FROM (SELECT source_id AS id, weight AS o, 0.0 AS i, 1 AS no, 0 AS ni FROM e UNION ALL SELECT target_id, 0.0, weight, 0, 1 FROM e) GROUP BY 1)"
_ALPHA = "CASE WHEN {k} <= 1 THEN 1.0 WHEN 1 - {p} <= 0 THEN 0.0 WHEN 1 - {p} >= 1 THEN 1.0 ELSE exp(greatest(({k} - 1) * ln(1 - {p}), -700.0)) END"


def _backbone(method: str, scores: tuple[str, ...] = (), **kwargs: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = backbone.apply_backbone(summed(spark, d), None, method, include_scores=bool(scores), **kwargs)
        return r6(out.select("source_id", "target_id", "weight", *scores))

    return run


_EW = "source_id, target_id, round(weight, 6) AS weight"
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE weight >= 40", "bb_weight_explicit")(_backbone("weight", weight_threshold=40))
query(f"WITH {SUMMED} SELECT {_EW} FROM e ORDER BY weight DESC, source_id, target_id LIMIT 500", "bb_weight_topk")(_backbone("weight", target_edges=500))
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE weight >= (SELECT median(weight) FROM e)", "bb_weight_median")(_backbone("weight"))
query(f"WITH {SUMMED}, {_STRENGTH}, m AS (SELECT floor(median(no + ni)) AS m FROM st), k AS (SELECT id FROM st, m WHERE no + ni >= m) SELECT {_EW} FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)", "bb_degree_median")(_backbone("degree"))
query(f"WITH {SUMMED}, {_STRENGTH}, k AS (SELECT id FROM st ORDER BY no + ni DESC, id LIMIT 300) SELECT {_EW} FROM e WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)", "bb_degree_topk")(_backbone("degree", target_nodes=300))

_DISPARITY = f"WITH {SUMMED}, {_STRENGTH}, x AS (SELECT e.*, weight / (u.o + u.i) AS pu, weight / (v.o + v.i) AS pv, u.no + u.ni AS ku, v.no + v.ni AS kv FROM e JOIN st u ON u.id = source_id JOIN st v ON v.id = target_id), y AS (SELECT *, least(pu, pv) AS p, least({_ALPHA.format(k='ku', p='pu')}, {_ALPHA.format(k='kv', p='pv')}) AS a FROM x)"
query(_DISPARITY + f" SELECT {_EW}, round(p, 6) AS p_value, round(a, 6) AS alpha_score, a < 0.05 OR a >= 1 AS kept FROM y", "bb_disparity_undirected")(_backbone("disparity", ("p_value", "alpha_score", "kept")))
query(_DISPARITY + f" SELECT {_EW} FROM y WHERE a < 0.05 OR a >= 1 OR source_id = 's1' OR target_id = 's1'", "bb_protected")(_backbone("disparity", protected_nodes=["s1"]))
query(_DISPARITY + f" SELECT {_EW} FROM y ORDER BY a, source_id, target_id LIMIT (SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) FROM e)", "bb_disparity_fraction")(_backbone("disparity", target_fraction=0.1))
_DIRECTED = f"WITH {PEERS}, {_STRENGTH}, x AS (SELECT e.*, CASE WHEN u.o > 0 THEN weight / u.o ELSE 0 END AS p, u.no + u.ni AS k, u.o > 0 AND v.o > 0 AS valid FROM e JOIN st u ON u.id = source_id LEFT JOIN (SELECT * FROM st WHERE no > 0) v ON v.id = target_id), y AS (SELECT *, {_ALPHA.format(k='k', p='p')} AS a FROM x)"


@query(_DIRECTED + f" SELECT {_EW}, round(p, 6) AS p_value, round(a, 6) AS alpha_score, (a < 0.3 OR a >= 1) AND valid AS kept FROM y")
def bb_disparity_directed(spark: SparkSession, d: str) -> DataFrame:
    return r6(backbone.apply_backbone(peers(spark, d), method="disparity", alpha=0.3, directed=True, include_scores=True))


_NC = f"""WITH {SUMMED}, {_STRENGTH}, x AS (SELECT e.*, {{u}} AS u, {{v}} AS v, {{n}} * (SELECT sum(weight) FROM e) AS n FROM e JOIN st a ON a.id = source_id JOIN st b ON b.id = target_id),
y AS (SELECT *, n / (u * v) AS k, u * v / (n * n) AS m, u * v * (n - u) * (n - v) / (n * n * n * n * (n - 1)) AS va FROM x),
z AS (SELECT *, (k * weight - 1) / (k * weight + 1) AS score, m * m / va * (1 - m) - m + weight AS al, n - weight + m / va * (1 - m * m) - (1 - m) AS be, 1 / (u * v) - n * (u + v) / (u * v * u * v) AS dd FROM y),
s AS (SELECT *, sqrt(greatest((al / (al + be)) * (1 - al / (al + be)) * n * pow(2 * (k + weight * dd) / pow(k * weight + 1, 2), 2), 0)) AS sd FROM z)"""
_NCU, _NCD = (_NC.format(u=u, v=v, n=n) for u, v, n in (("a.o + a.i", "b.o + b.i", "2"), ("a.o", "b.i", "1")))
query(_NCU + f" SELECT {_EW}, round(score, 6) AS score, round(sd, 6) AS sdev_cij, score - sd > 0 AS kept FROM s", "bb_noise_corrected")(_backbone("noise_corrected", ("score", "sdev_cij", "kept")))
query(_NCD + f" SELECT {_EW}, round(score, 6) AS score, round(sd, 6) AS sdev_cij, score - 1.28 * sd > 0 AS kept FROM s", "bb_noise_corrected_directed")(_backbone("noise_corrected", ("score", "sdev_cij", "kept"), directed=True, threshold=1.28))
query(_NCU + f" SELECT {_EW} FROM s ORDER BY round(score - sd, 12) DESC, source_id, target_id LIMIT 1000", "bb_noise_corrected_topk")(_backbone("noise_corrected", target_edges=1000))

_SVN = f"WITH {SHARES}, e AS (SELECT DISTINCT source AS source_id, target AS target_id, 1.0 AS weight FROM shares), {_STRENGTH}, x AS (SELECT e.*, 1 - exp(-(u.o + u.i) * (v.o + v.i) / (SELECT sum(weight) FROM e)) AS p FROM e JOIN st u ON u.id = source_id JOIN st v ON v.id = target_id)"


def _svn(alpha: float, correction: str, retention: float | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = shares(spark, d).select(F.col("source").alias("source_id"), F.col("target").alias("target_id")).distinct().withColumn("weight", F.lit(1.0))
        return r6(backbone.apply_backbone(e, method="bipartite_svn", alpha=alpha, correction=correction, min_node_retention=retention, include_scores=True))

    return run


_SVNP = "source_id, target_id, CAST(weight AS DOUBLE) AS weight, round(p, 6) AS p_value"
_BH = "c AS (SELECT max(p) AS cut FROM (SELECT p, count(*) OVER (ORDER BY p) AS r FROM x) WHERE p <= r / (SELECT count(*) FROM x) * 0.9)"
query(_SVN + f" SELECT {_SVNP}, p <= 0.8 AS kept FROM x", "bb_svn_unweighted")(_svn(0.8, "none"))
query(_SVN + f" SELECT {_SVNP}, p <= 0.05 / (SELECT count(*) FROM x) AS kept FROM x", "bb_svn_bonferroni")(_svn(0.05, "bonferroni"))
query(_SVN + f", {_BH} SELECT {_SVNP}, coalesce(p <= cut, false) AS kept FROM x, c", "bb_svn_fdr")(_svn(0.9, "fdr_bh"))
query(_SVN + f", y AS (SELECT *, p <= 0.8 AS k FROM x), t AS (SELECT id FROM (SELECT source_id AS id, k FROM y UNION ALL SELECT target_id, k FROM y) GROUP BY id HAVING avg(CAST(k AS INTEGER)) < 0.3) SELECT {_SVNP}, k AND source_id NOT IN (SELECT id FROM t) AND target_id NOT IN (SELECT id FROM t) AS kept FROM y", "bb_svn_retention")(_svn(0.8, "none", 0.3))


@query(f"WITH {SUMMED}, {_STRENGTH}, x AS (SELECT e.*, (u.o + u.i) * (v.o + v.i) / (SELECT sum(weight) FROM e) AS mu, CAST(ceil(weight) AS INTEGER) AS c FROM e JOIN st u ON u.id = source_id JOIN st v ON v.id = target_id) SELECT {_EW}, round(CASE WHEN c = 0 THEN 1.0 ELSE greatest(0, 1 - list_sum([exp(i * ln(mu) - mu - lgamma(i + 1)) for i in range(0, c)])) END, 6) AS p_value FROM x")
def bb_svn_weighted(spark: SparkSession, d: str) -> DataFrame:
    return r6(backbone.bipartite_svn(summed(spark, d), correction="none").select("source_id", "target_id", "weight", "p_value"))


# Filters and neighbourhoods.

_DEGREE = "g AS (SELECT id, count(*) AS d FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY 1)"


def _filter(spec: dict, combine: str = "and") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: r6(filters.filter_edges(summed(spark, d), spec, combine))


_IN = "source_id IN (SELECT id FROM {0}) AND target_id IN (SELECT id FROM {0})"
query(f"WITH {SUMMED}, {_DEGREE}, k AS (SELECT id FROM g WHERE d >= 25) SELECT {_EW} FROM e WHERE {_IN.format('k')}", "filter_min_degree")(_filter({"min_degree": 25}))
query(f"WITH {SUMMED}, {_DEGREE}, k AS (SELECT id FROM g WHERE d <= 600) SELECT {_EW} FROM e WHERE {_IN.format('k')}", "filter_max_degree")(_filter({"max_degree": 600}))
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE target_id IN (SELECT target_id FROM e GROUP BY 1 HAVING count(DISTINCT source_id) >= 25) AND source_id IN (SELECT source_id FROM e GROUP BY 1 HAVING count(DISTINCT target_id) <= 520)", "filter_partition_degree")(_filter({"min_target_degree": 25, "max_source_degree": 520}))
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE weight >= 30", "filter_weight")(_filter({"min_weight": 30}))
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE source_id IN ('s1', 's2', 's3') AND target_id IN ('p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7', 'p8', 'p9')", "filter_nodes")(_filter({"nodes": ["s1", "s2", "s3", *[f"p{i}" for i in range(1, 10)]]}))
query(f"WITH {SUMMED} SELECT {_EW} FROM e WHERE source_id NOT IN ('s1', 's2') AND target_id <> 'p5'", "filter_exclude")(_filter({"exclude_nodes": ["s1", "s2", "p5"]}))
query(f"WITH {SUMMED}, {_DEGREE}, k AS (SELECT id FROM g WHERE d >= 20 AND d <= 600) SELECT {_EW} FROM e WHERE {_IN.format('k')} AND weight >= 20", "filter_and")(_filter({"min_degree": 20, "max_degree": 600, "min_weight": 20}))
query(f"WITH {SUMMED}, {_DEGREE}, k AS (SELECT id FROM g WHERE d >= 20) SELECT {_EW} FROM e WHERE {_IN.format('k')} AND (weight >= 40 OR target_id IN (SELECT target_id FROM e GROUP BY 1 HAVING count(DISTINCT source_id) >= 30))", "filter_or")(_filter({"min_degree": 20, "min_weight": 40, "min_target_degree": 30}, "or"))


def stars(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers and customers, each with its nation."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    return s.union(c).withColumn("weight", F.lit(1.0))


STARS = "e AS (SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id, 1.0 AS weight FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 1.0 FROM customer)"
_PARTS = f"WITH {STARS}, m AS (SELECT target_id AS n, least(min(source_id), target_id) AS component FROM e GROUP BY 1, target_id), p AS (SELECT n AS node_id, component FROM m UNION SELECT source_id, component FROM e JOIN m ON n = target_id)"


@query(_PARTS + " SELECT node_id, component FROM p")
def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(stars(spark, d))


@query(_PARTS + ", t AS (SELECT component FROM p GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node_id FROM p WHERE component = (SELECT component FROM t)")
def filter_giant_component(spark: SparkSession, d: str) -> DataFrame:
    return giant_component(stars(spark, d))


def _graph(frame: DataFrame, directed: bool = False) -> tuple[EdgeList, IDMapper]:
    return from_frame(frame, directed)


_HOPS = "h0 AS (SELECT 's1' AS id), h1 AS (SELECT id FROM h0 UNION SELECT target_id FROM s JOIN h0 ON source_id = id), h2 AS (SELECT id FROM h1 UNION SELECT target_id FROM s JOIN h1 ON source_id = id)"


@query(f"WITH {STARS}, s AS (SELECT source_id, target_id FROM e UNION SELECT target_id, source_id FROM e), {_HOPS} SELECT source_id, target_id, CAST(weight AS DOUBLE) AS weight FROM e WHERE {_IN.format('h2')}")
def khop_both(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = _graph(stars(spark, d))
    small, names = filters.filter_by_seed_proximity(el, mapper, ["s1"], "khop", hops=2)
    return small.frame(names)


@query(f"WITH {STARS}, s AS (SELECT source_id, target_id FROM e), {_HOPS} SELECT source_id, target_id, CAST(weight AS DOUBLE) AS weight FROM e WHERE {_IN.format('h2')}")
def khop_out(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = _graph(stars(spark, d), True)
    small, names = filters.filter_by_seed_proximity(el, mapper, ["s1"], "khop", hops=2, direction="out")
    return small.frame(names)


def _rounds(k: int, step: str, first: str) -> str:
    """k rounds of a step as common table expressions x0..xk; step reads {x}."""
    return ", ".join([f"x0 AS ({first})"] + [f"x{i} AS ({step.format(x=f'x{i - 1}')})" for i in range(1, k + 1)])


_SYM = "a AS (SELECT source_id AS a, target_id AS b, weight AS w FROM e UNION ALL SELECT target_id, source_id, weight FROM e), t AS (SELECT a, sum(w) AS t FROM a GROUP BY 1), p AS (SELECT a.a, b, sum(w) / any_value(t) AS p FROM a JOIN t ON t.a = a.a GROUP BY a.a, b), n AS (SELECT DISTINCT a AS id FROM a)"
_PPR = "SELECT n.id, 0.85 * coalesce(sum(v * p), 0) + CASE WHEN n.id = 'u1' THEN 0.15 ELSE 0 END AS v FROM n LEFT JOIN p ON p.b = n.id LEFT JOIN {x} ON {x}.id = p.a GROUP BY n.id"

_ONE = "SELECT id, CASE WHEN id = 'u1' THEN 1.0 ELSE 0.0 END AS v FROM n"


@query(f"WITH {PEERS}, {_SYM}, {_rounds(10, _PPR, _ONE)} SELECT id AS node_id, round(v, 6) AS ppr FROM x10")
def ppr_fixed(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    start = mapper.nodes.where("node_id = 'u1'").select("code")
    x = filters.personalised_pagerank(el, start, mapper.nodes, max_iter=10, tol=0.0)
    return r6(mapper.decode(x, "code", "node_id").select("node_id", "ppr"))


def _until(step: str, first: str, values: str, tol: float, most: int, name: str = "x") -> str:
    """Rounds of a step from first (id and values) until no value changes by tol, or most rounds; ``name`` has all rounds, numbered k. step reads {name}."""
    moved = ", ".join(f"abs(n.{v} - o.{v})" for v in values.split(", "))
    new = ", ".join(f"n.{v}" for v in values.split(", "))
    start = ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in values.split(", "))
    return f"{name} AS (SELECT id, 0 AS k, {start}, CAST(1 AS DOUBLE) AS moved FROM ({first}) UNION ALL SELECT n.id, o.k + 1, {new}, max(greatest({moved})) OVER () FROM ({step}) n JOIN {name} o ON o.id = n.id WHERE o.moved >= {tol!r} AND o.k < {most})"


def _last(name: str = "x") -> str:
    return f"(SELECT * FROM {name} WHERE k = (SELECT max(k) FROM {name}))"


_PPR2 = "SELECT n.id, 0.85 * coalesce(sum(v * p), 0) + CASE WHEN n.id IN ('u1', 'u2') THEN 0.075 ELSE 0 END AS v FROM n LEFT JOIN p ON p.b = n.id LEFT JOIN x ON x.id = p.a GROUP BY n.id"
_TOPN = f"WITH RECURSIVE {PEERS}, {_SYM}, {_until(_PPR2, 'SELECT id, CASE WHEN id IN (' + chr(39) + 'u1' + chr(39) + ', ' + chr(39) + 'u2' + chr(39) + ') THEN 0.5 ELSE 0.0 END AS v FROM n', 'v', 1e-6, 100)}, near AS (SELECT id FROM (SELECT id FROM {_last()} ORDER BY round(v, 9) DESC, id LIMIT 40) UNION SELECT 'u1' UNION SELECT 'u2') SELECT source_id, target_id, round(weight, 6) AS weight FROM e WHERE source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near)"


@query(_TOPN)
def ppr_topn(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    small, names = filters.filter_by_seed_proximity(el, mapper, ["u1", "u2"], "ppr", top_n=40)
    return r6(small.frame(names))


@query()
def lte_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = _graph(stars(spark, d))
    small, names = filters.filter_by_seed_proximity(el, mapper, ["s1", "n1"], "lte")
    return small.frame(names)


# Centrality.


def _central(metric: str, frame: Callable, directed: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: r6(centrality.centrality(frame(spark, d), metric, directed=directed))


def _central_peers(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        el, mapper = peer_graph(spark, d)
        x = centrality.centrality(el, metric).withColumnRenamed("node_id", "code")
        return r6(mapper.decode(x, "code", "node_id").select("node_id", "value"))

    return run


query(f"WITH {SUMMED}, {_DEGREE} SELECT id AS node_id, round(d / ((SELECT count(*) FROM g) - 1), 6) AS value FROM g", "centrality_degree")(_central("degree", summed))
query(f"WITH {SUMMED}, n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e), c AS (SELECT target_id AS id, count(*) AS d FROM e GROUP BY 1) SELECT id AS node_id, round(coalesce(d, 0) / ((SELECT count(*) FROM n) - 1), 6) AS value FROM n LEFT JOIN c USING (id)", "centrality_in_degree")(_central("in_degree", summed, True))
query(f"WITH {SUMMED}, n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e), c AS (SELECT source_id AS id, count(*) AS d FROM e GROUP BY 1) SELECT id AS node_id, round(coalesce(d, 0) / ((SELECT count(*) FROM n) - 1), 6) AS value FROM n LEFT JOIN c USING (id)", "centrality_out_degree")(_central("out_degree", summed, True))
_PAIRDIST = f"WITH {STARS}, n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e), g AS (SELECT target_id AS h, count(*) AS d FROM e GROUP BY 1), v AS (SELECT target_id AS id, CAST(d AS DOUBLE) AS near, 0.0 AS far, d * (d - 1) / 2.0 AS between FROM e JOIN g ON h = target_id GROUP BY ALL UNION ALL SELECT source_id, 1.0, (d - 1) / 2.0, 0.0 FROM e JOIN g ON h = target_id)"
query(_PAIRDIST + " SELECT id AS node_id, round((near + far) / ((SELECT count(*) FROM n) - 1), 6) AS value FROM v", "centrality_closeness")(_central("closeness", stars))
query(_PAIRDIST + " SELECT id AS node_id, round(between / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2) / 2.0), 6) AS value FROM v", "centrality_betweenness")(_central("betweenness", stars))
_N = "(SELECT count(*) FROM n)"
_EIGEN = "SELECT id, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT n.id, coalesce(sum(x.v * w), 0) AS v FROM n LEFT JOIN a ON a.b = n.id LEFT JOIN x ON x.id = a.a GROUP BY n.id)"
_KATZ = "SELECT n.id, 1.0 + coalesce(sum(x.v * w), 0) / (SELECT max(c) + 1 FROM (SELECT count(DISTINCT a) AS c FROM a GROUP BY b)) AS v FROM n LEFT JOIN a ON a.b = n.id LEFT JOIN x ON x.id = a.a GROUP BY n.id"
_PRX = f"SELECT n.id, 0.15 / {_N} + 0.85 * coalesce(sum(x.v * p), 0) AS v FROM n LEFT JOIN p ON p.b = n.id LEFT JOIN x ON x.id = p.a GROUP BY n.id"
query(f"WITH RECURSIVE {PEERS}, {_SYM}, {_until(_EIGEN, f'SELECT id, 1 / sqrt({_N}) AS v FROM n', 'v', 1e-8, 100)} SELECT id AS node_id, round(v / (SELECT max(v) FROM {_last()}), 6) AS value FROM {_last()}", "centrality_eigenvector")(_central_peers("eigenvector"))
query(f"WITH RECURSIVE {PEERS}, {_SYM}, {_until(_KATZ, 'SELECT id, 0.0 AS v FROM n', 'v', 1e-8, 100)} SELECT id AS node_id, round(v / (SELECT max(v) FROM {_last()}), 6) AS value FROM {_last()}", "centrality_katz")(_central_peers("katz"))
query(f"WITH RECURSIVE {PEERS}, {_SYM}, {_until(_PRX, f'SELECT id, 1.0 / {_N} AS v FROM n', 'v', 1e-8, 100)}, m AS (SELECT min(v) AS lo, max(v) AS hi FROM {_last()}) SELECT id AS node_id, round((v - lo) / (hi - lo), 6) AS value FROM {_last()}, m", "centrality_pagerank")(_central_peers("pagerank"))
_PR = "SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(sum(v * p), 0) AS v FROM n LEFT JOIN p ON p.b = n.id LEFT JOIN {x} ON {x}.id = p.a GROUP BY n.id"


@query(f"WITH {PEERS}, {_SYM}, {_rounds(10, _PR, 'SELECT id, 1.0 / (SELECT count(*) FROM n) AS v FROM n')} SELECT id AS node_id, round(v, 6) AS value FROM x10")
def pagerank_fixed(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    x = centrality.power_iteration(el, mapper.nodes.select(F.col("code").alias("node_id")), "pagerank", iterations=10, tol=0.0).withColumnRenamed("node_id", "code")
    return r6(mapper.decode(x, "code", "node_id").select("node_id", "value"))


_SUMMARY = "CAST(count(v) AS BIGINT) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75"


@query(f"WITH {SUMMED}, {_DEGREE}, x AS (SELECT d / ((SELECT count(*) FROM g) - 1) AS v FROM g) SELECT 'degree_centrality' AS metric, {_SUMMARY} FROM x")
def centrality_summary(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = _graph(summed(spark, d))
    return r6(centrality.centrality_summary(centrality.extract_centrality(el, mapper, ["degree"])))


@query(f"WITH {PEERS}, s AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), g AS (SELECT a, count(*) AS d FROM s GROUP BY 1), t AS (SELECT x.a, count(*) AS t FROM s x JOIN s y ON x.b = y.a JOIN s z ON z.a = y.b AND z.b = x.a GROUP BY 1) SELECT a AS node_id, round(CASE WHEN d < 2 THEN 0.0 ELSE coalesce(t, 0) / (d * (d - 1)) END, 6) AS clustering FROM g LEFT JOIN t USING (a)")
def clustering_alpha(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    return r6(mapper.decode(seeds.local_clustering(el), "code", "node_id").select("node_id", "clustering"))


# Communities, reduction.


def likes(spark: SparkSession, d: str) -> tuple[EdgeList, IDMapper, DataFrame]:
    """Nearest neighbours of embeddings, and their label as a partition."""
    v = table(spark, d, "embeddings")
    e = embed.extract_embedding_similarity_edgelist(v.withColumn("post", F.lit("")), sender_col="vec_id", embedding_col="embedding", k=5)
    el, mapper = from_frame(e.withColumnsRenamed({"source": "source_id", "target": "target_id"}))
    parts = v.select(F.col("vec_id").alias("node_id"), F.col("label").cast("long").alias("community"))
    return el, mapper, mapper.nodes.join(parts, "node_id").select("code", "node_id", "community")


@query(f"WITH {PEERS}, m AS (SELECT id, CAST(substr(id, 2) AS BIGINT) % 5 AS c FROM (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)) SELECT CAST(a.c AS BIGINT) AS src, CAST(b.c AS BIGINT) AS tgt, round(sum(weight), 6) AS weight FROM e JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id GROUP BY ALL")
def quotient_graph(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    parts = mapper.nodes.select("code", (F.substring("node_id", 2, 20).cast("long") % 5).alias("community"))
    return r6(reduce.quotient_edges(el.weighted(), parts))


@query("SELECT 'community_' || label AS node_id, CAST(count(*) AS BIGINT) AS member_count, string_agg(CAST(vec_id AS VARCHAR), '|' ORDER BY CAST(vec_id AS VARCHAR)) AS member_ids FROM embeddings GROUP BY label")
def supernode_attrs(spark: SparkSession, d: str) -> DataFrame:
    return reduce.supernode_attributes(table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("community")))


@query("WITH l AS (SELECT vec_id AS code, i AS it, CASE i WHEN 0 THEN label WHEN 1 THEN label % 3 ELSE vec_id % 4 END AS c FROM embeddings, range(3) t(i)), v AS (SELECT code, c, count(*) AS n, min(it) AS seen FROM l GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, seen) AS r FROM v), z AS (SELECT * FROM w WHERE r = 1) SELECT code, CAST(dense_rank() OVER (ORDER BY c) - 1 AS BIGINT) AS community_consensus, round(n / 3, 6) AS stability FROM z")
def communities_consensus(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("code"), F.col("label").cast("long").alias("l"))
    runs = [v.select("code", F.lit(i).alias("iteration"), c.cast("long").alias("community")) for i, c in enumerate((F.col("l"), F.col("l") % 3, F.col("code") % 4))]
    return r6(communities.consensus(runs[0].union(runs[1]).union(runs[2])))


@query()
def communities_louvain(spark: SparkSession, d: str) -> DataFrame:
    el, mapper, _ = likes(spark, d)
    return r6(communities.detect_communities(el, mapper, iterations=2, random_seed=1))


@query()
def reduce_grouping(spark: SparkSession, d: str) -> DataFrame:
    el, mapper, _ = likes(spark, d)
    return reduce.reduce_by_grouping(el, mapper, random_seed=1)[2]


@query()
def reduce_influence(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    small, names, _ = reduce.reduce_by_influence(el, mapper, backbone_method="weight", target_nodes=50)
    return r6(small.frame(names))


@query()
def reduce_sampling(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    return reduce.reduce_by_sampling(el, mapper, target_nodes=50, random_seed=3)[1].nodes.select("node_id")


# Label propagation.

LABELS = ["a", "b"]
SEEDS = {"u1": "a", "u2": "a", "u3": "b", "u4": "b"}
_SEEDS = "z AS (SELECT * FROM (VALUES ('u1', 1.0, 0.0), ('u2', 1.0, 0.0), ('u3', 0.0, 1.0), ('u4', 0.0, 1.0)) z(id, ya, yb))"
_Y = "y AS (SELECT n.id, coalesce(ya, 0.0) AS ya, coalesce(yb, 0.0) AS yb, z.id IS NOT NULL AS s FROM n LEFT JOIN z USING (id))"
_GLP = "SELECT y.id, 0.85 * coalesce(sum(p * fa), 0) + 0.15 * any_value(ya) AS fa, 0.85 * coalesce(sum(p * fb), 0) + 0.15 * any_value(yb) AS fb FROM y LEFT JOIN p ON p.a = y.id LEFT JOIN {x} ON {x}.id = p.b GROUP BY y.id"
_RESULT = "f AS (SELECT x.id, s, CASE WHEN fa + fb > 0 THEN fa / (fa + fb) ELSE 0.5 END AS pa, CASE WHEN fa + fb > 0 THEN fb / (fa + fb) ELSE 0.5 END AS pb FROM {x} x JOIN y ON y.id = x.id)"
_GLPOUT = "SELECT id AS node_id, round(pa, 6) AS a_prob, round(pb, 6) AS b_prob, CASE WHEN round(pa, 9) >= round(pb, 9) THEN 'a' ELSE 'b' END AS dominant_label, round(greatest(pa, pb), 6) AS confidence, s AS is_seed FROM f"
_ARCS = "a AS (SELECT {s} AS a, {t} AS b, {w} AS w FROM e), t AS (SELECT a, sum(w) AS t FROM a GROUP BY 1), p AS (SELECT a.a, b, w / t AS p FROM a JOIN t ON t.a = a.a), n AS (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)"


def _glp_sql(graph: str, arcs: str, k: int, end: str = _GLPOUT) -> str:
    return f"WITH {graph}, {arcs}, {_SEEDS}, {_Y}, {_rounds(k, _GLP, 'SELECT id, ya AS fa, yb AS fb FROM y')}, {_RESULT.format(x=f'x{k}')} {end}"


def _fixed(el: EdgeList, mapper: IDMapper, direction: str = "out_degree", k: int = 5, transform: Callable | None = None) -> DataFrame:
    p = propagate.transition(el, direction, transform)
    f, _, _ = propagate.spread(p, propagate.start_matrix(mapper, SEEDS, LABELS), 0.85, k)
    tidy = f.select("node", F.transform("f", lambda x: F.round(x, 15)).alias("f"))
    return propagate.results(tidy, mapper, LABELS, SEEDS)


@query(_glp_sql(PEERS, _SYM, 5))
def glp_fixed_k(spark: SparkSession, d: str) -> DataFrame:
    return r6(_fixed(*peer_graph(spark, d)))


@query(_glp_sql(ANSWERS, _ARCS.format(s="source_id", t="target_id", w="weight"), 4))
def glp_directional_out(spark: SparkSession, d: str) -> DataFrame:
    return r6(_fixed(*answers(spark, d), "out_degree", 4))


@query(_glp_sql(ANSWERS, _ARCS.format(s="target_id", t="source_id", w="weight"), 4))
def glp_directional_in(spark: SparkSession, d: str) -> DataFrame:
    return r6(_fixed(*answers(spark, d), "in_degree", 4))


@query(_glp_sql(PEERS, _SYM, 5, _GLPOUT.replace("CASE WHEN round(pa, 9)", "CASE WHEN greatest(pa, pb) < 0.55 THEN 'uncertain' WHEN round(pa, 9)") + " WHERE id <> 'u1'"))
def glp_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(propagate.finished(_fixed(*peer_graph(spark, d)), 0.55, ["u1"]))


@query(_glp_sql(ANSWERS, _ARCS.format(s="target_id", t="source_id", w="least(ln(1 + weight), 3.0)"), 4))
def glp_transform(spark: SparkSession, d: str) -> DataFrame:
    return r6(_fixed(*answers(spark, d), "in_degree", 4, lambda w: transformed(transformed(w, log1p_transform()), winsorize_transform(3.0))))


@query(f"WITH {ANSWERS} SELECT source_id, target_id, round((exp(2 * (weight + 1) / 100) - 1) / (exp(2 * (weight + 1) / 100) + 1), 6) AS weight FROM e")
def weight_tanh(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = answers(spark, d)
    return r6(el.frame(mapper).withColumn("weight", transformed(F.col("weight"), tanh_transform())))


@query(_glp_sql(ANSWERS, _ARCS.format(s="target_id", t="source_id", w="weight"), 4, "SELECT target_id AS node_id, round(sum(weight * pa) / sum(weight), 6) AS a_prob, round(sum(weight * pb) / sum(weight), 6) AS b_prob FROM e JOIN f ON f.id = source_id GROUP BY target_id"))
def audience_pass(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = answers(spark, d)
    return r6(propagate.audience_pass(el.frame(mapper), _fixed(el, mapper, "in_degree", 4), ["a_prob", "b_prob"]))


_GLPX = _GLP.format(x="x")
_CONVERGED = f"WITH RECURSIVE {PEERS}, {_SYM}, {_SEEDS}, {_Y}, {_until(_GLPX, 'SELECT id, ya AS fa, yb AS fb FROM y', 'fa, fb', 1e-6, 100)}, {_RESULT.format(x=_last())}"


@query(_CONVERGED + " " + _GLPOUT)
def glp_converged(spark: SparkSession, d: str) -> DataFrame:
    return r6(propagate.guided_label_propagation(*peer_graph(spark, d), SEEDS, LABELS))


@query()
def glp_noise(spark: SparkSession, d: str) -> DataFrame:
    return r6(propagate.guided_label_propagation(*peer_graph(spark, d), SEEDS, LABELS, enable_noise_category=True, noise_ratio=0.5))


_NOISE = "y3 AS (SELECT y.*, CAST(y.id IN ('u5', 'u6') AS INTEGER) * 1.0 AS yn FROM y)"
_GLP3 = "SELECT y.id, " + ", ".join(f"0.85 * coalesce(sum(p * x.f{c}), 0) + 0.15 * any_value(y{c}) AS f{c}" for c in "abn") + " FROM y3 y LEFT JOIN p ON p.a = y.id LEFT JOIN x ON x.id = p.b GROUP BY y.id"
_OUT3 = "SELECT f.id AS node_id, round(fa / t, 6) AS a_prob, round(fb / t, 6) AS b_prob, round(fn / t, 6) AS noise_prob, CASE WHEN round(fa, 9) >= round(greatest(fb, fn), 9) THEN 'a' WHEN round(fb, 9) >= round(fn, 9) THEN 'b' ELSE 'noise' END AS dominant_label, round(greatest(fa, fb, fn) / t, 6) AS confidence, s OR y.yn = 1 AS is_seed FROM (SELECT *, fa + fb + fn AS t FROM " + _last() + ") f JOIN y3 y ON y.id = f.id"


@query(f"WITH RECURSIVE {PEERS}, {_SYM}, {_SEEDS}, {_Y}, {_NOISE}, {_until(_GLP3, 'SELECT id, ya AS fa, yb AS fb, yn AS fn FROM y3', 'fa, fb, fn', 1e-6, 100)} {_OUT3}")
def glp_noise_given(spark: SparkSession, d: str) -> DataFrame:
    """With noise seeds that are given instead of drawn."""
    return r6(propagate.guided_label_propagation(*peer_graph(spark, d), SEEDS | {"u5": propagate.NOISE, "u6": propagate.NOISE}, LABELS, enable_noise_category=True))


_PRIOR = (
    "WITH RECURSIVE " + STARS + ", " + _SYM + ", z AS (SELECT * FROM (VALUES ('s1', 1.0, 0.0), ('s2', 0.0, 1.0)) z(id, ya, yb)), " + _Y
    + ", u AS (SELECT DISTINCT a, b FROM a), h AS (SELECT id AS seed, id, 0 AS hop FROM z UNION SELECT seed, u.b, hop + 1 FROM h JOIN u ON u.a = h.id WHERE hop < 2), g AS (SELECT seed, id, min(hop) AS hop FROM h GROUP BY ALL)"
    + ", d AS (SELECT n.id, coalesce(sum(ya / (hop + 1)), 0) AS da, coalesce(sum(yb / (hop + 1)), 0) AS db FROM n LEFT JOIN g ON g.id = n.id LEFT JOIN z ON z.id = seed GROUP BY n.id), "
    + _until("SELECT y.id, 0.85 * coalesce(sum(p * x.fa * d.da), 0) + 0.15 * any_value(ya) AS fa, 0.85 * coalesce(sum(p * x.fb * d.db), 0) + 0.15 * any_value(yb) AS fb FROM y LEFT JOIN p ON p.a = y.id LEFT JOIN x ON x.id = p.b LEFT JOIN d ON d.id = x.id GROUP BY y.id", "SELECT id, ya AS fa, yb AS fb FROM y", "fa, fb", 1e-6, 100)
    + ", " + _RESULT.format(x=_last()) + " " + _GLPOUT
)  # nations are stars: two steps reach all that a seed reaches


@query(_PRIOR)
def glp_distance_prior(spark: SparkSession, d: str) -> DataFrame:
    return r6(propagate.guided_label_propagation(*_graph(stars(spark, d)), {"s1": "a", "s2": "b"}, LABELS, distance_prior=True))


@query()
def glp_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return r6(propagate.ensemble_label_propagation(*peer_graph(spark, d), SEEDS, LABELS, n_epochs=4, return_variance=True, enable_noise_category=True, noise_ratio=0.5))


# Validation, evaluation, seeds.


@query(_glp_sql(PEERS, _SYM, 5, "SELECT dominant_label, CAST(count(*) AS BIGINT) AS n, round(avg(greatest(pa, pb)), 6) AS mean_confidence FROM (SELECT *, CASE WHEN round(pa, 9) >= round(pb, 9) THEN 'a' ELSE 'b' END AS dominant_label FROM f) GROUP BY 1"))
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluate.label_distribution(_fixed(*peer_graph(spark, d))))


@query(_glp_sql(PEERS, _SYM, 5, "SELECT round(avg(-(pa * ln(pa) + pb * ln(pb))), 6) AS label_entropy FROM (SELECT least(greatest(pa, 1e-10), 1) AS pa, least(greatest(pb, 1e-10), 1) AS pb FROM f)"))
def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    return r6(evaluate.label_entropy(_fixed(*peer_graph(spark, d)), LABELS))


@query("SELECT l AS label, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'q' AS l, c_acctbal / 10000 AS p FROM customer UNION ALL SELECT 'r', 1 - c_acctbal / 10000 FROM customer) WHERE p BETWEEN 0 AND 1 GROUP BY ALL")
def probability_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("c_acctbal") / 10000
    return evaluate.probability_histogram(table(spark, d, "customer").select(p.alias("q_prob"), (1 - p).alias("r_prob")), ["q", "r"])


def _direction(s: str, t: str, c: str) -> str:
    """f{c}: the result of four rounds along one direction; tables are named apart by c."""
    sql = f"{_ARCS.format(s=s, t=t, w='weight')}, {_SEEDS}, {_Y}, {_rounds(4, _GLP, 'SELECT id, ya AS fa, yb AS fb FROM y')}, {_RESULT.format(x='x4')}"
    return f"f{c} AS (WITH {sql} SELECT id, pa, pb, round(pa, 9) >= round(pb, 9) AS l FROM f)"


@query(f"WITH {ANSWERS}, {_direction('source_id', 'target_id', 'o')}, {_direction('target_id', 'source_id', 'i')} SELECT round(avg(CAST(o.l = i.l AS INTEGER)), 6) AS agreement_rate, round(avg(greatest(o.pa, o.pb)), 6) AS out_degree_confidence, round(avg(greatest(i.pa, i.pb)), 6) AS in_degree_confidence, round(corr(o.pa, i.pa), 6) AS a_correlation, round(avg(o.pa), 6) AS a_out, round(avg(i.pa), 6) AS a_in, round(corr(o.pb, i.pb), 6) AS b_correlation, round(avg(o.pb), 6) AS b_out, round(avg(i.pb), 6) AS b_in FROM fo o JOIN fi i USING (id)")
def directional_agreement(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = answers(spark, d)
    merged = evaluate.merged_directions(_fixed(el, mapper, "out_degree", 4), _fixed(el, mapper, "in_degree", 4), LABELS)
    return r6(evaluate.directional_agreement(merged, LABELS))


_PREDICTED = "p AS (SELECT doc_id, CAST(quality AS VARCHAR) AS t, CASE WHEN n_chars >= 400 THEN '1' ELSE '0' END AS q FROM labels JOIN documents USING (doc_id))"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("quality").cast("string").alias("t"), F.when(F.col("n_chars") >= 400, "1").otherwise("0").alias("q"))


@query(f"WITH {_PREDICTED} SELECT t AS true_label, q AS predicted_label, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return validate.confusion(predicted(spark, d), "t", "q")


@query(f"WITH {_PREDICTED}, l AS (SELECT unnest(['0', '1', 'noise']) AS label), c AS (SELECT label, count(*) FILTER (t = label AND q = label) AS tp, count(*) FILTER (q = label) AS pp, count(*) FILTER (t = label) AS s FROM l, p GROUP BY 1), r AS (SELECT label, coalesce(tp / nullif(pp, 0), 0.0) AS pr, coalesce(tp / nullif(s, 0), 0.0) AS re, s FROM c) SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1_score, CAST(s AS BIGINT) AS support FROM r")
def prf_macro(spark: SparkSession, d: str) -> DataFrame:
    return r6(validate.label_scores(validate.confusion(predicted(spark, d), "t", "q"), ["0", "1", "noise"]))


@query("SELECT CAST(l.quality AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS total, CAST(count(v.vec_id) AS BIGINT) AS present FROM labels l LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = l.doc_id GROUP BY 1")
def seed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as seeds, in the graph of those that have a vector."""
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("vec_id").alias("code")).distinct()
    return seeds.seed_coverage(IDMapper(nodes), table(spark, d, "labels").select(F.col("doc_id").alias("node_id"), F.col("quality").cast("string").alias("label")))


@query(f"WITH {SHARES} SELECT '__stat__' || target AS source_id, source AS target_id, round(sum(weight), 6) AS weight FROM shares WHERE target IN ('k1', 'k2', 'k3') GROUP BY ALL")
def stat_user_edges(spark: SparkSession, d: str) -> DataFrame:
    contents = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "content string")
    return r6(seeds.stat_user_edges(shares(spark, d), contents, "source", "target", "weight"))


@query()
def cv_aggregate(spark: SparkSession, d: str) -> DataFrame:
    el, mapper = peer_graph(spark, d)
    known = {f"u{i}": LABELS[i % 2] for i in range(1, 13)}
    out = validate.cross_validate(el, mapper, known, LABELS, k_folds=3, random_seed=5)
    rows = [(k, float(v)) for k, v in sorted(out.items()) if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return r6(spark.createDataFrame(rows, "metric string, value double"))


# Slices of time.

_DAYS = "(SELECT CAST(d AS TIMESTAMP) AS lo, CAST(d AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS hi FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM events))"
_WEEKS = "(SELECT w AS lo, w + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS hi FROM (SELECT unnest(generate_series(date_trunc('week', min(ts)), max(ts), INTERVAL 7 DAY)) AS w, max(ts) AS last, min(ts) - date_trunc('day', min(ts)) AS clock FROM events) WHERE w + INTERVAL 6 DAY + clock <= last)"
_SLICED = f"WITH {SHARES}, c AS {{c}} SELECT strftime(hi, '%Y-%m-%d') AS slice, source AS source_id, target AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM shares JOIN c ON ts BETWEEN lo AND hi GROUP BY ALL"


def _slices(interval: str, **kwargs: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = temporal.create_temporal_slices(shares(spark, d), "ts", interval, **kwargs)
        return g.edges.select(F.date_format("slice_end", "yyyy-MM-dd").alias("slice"), "source_id", "target_id", "weight")

    return run


query(_SLICED.format(c=_DAYS), "slices_daily")(_slices("daily"))
query(_SLICED.format(c=_WEEKS), "slices_weekly")(_slices("weekly"))
query(_SLICED.format(c="(SELECT hi - INTERVAL 7 DAY + INTERVAL 1 MICROSECOND AS lo, hi FROM " + _DAYS + ")"), "slices_rolling")(_slices("daily", rolling_window=7))
query(_SLICED.format(c="(SELECT TIMESTAMP '0001-01-01' AS lo, hi FROM " + _WEEKS + ")"), "slices_cumulative")(_slices("weekly", cumulative=True))


def orders_by_month(spark: SparkSession, d: str, interval: str = "monthly") -> temporal.TemporalGraphs:
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    return temporal.create_temporal_slices(o, "ts", interval)


_MONTHLY = "o AS (SELECT strftime(date_trunc('{0}', o_orderdate) + INTERVAL 1 {0} - INTERVAL 1 DAY, '%Y-%m-%d') AS slice, 'c' || o_custkey AS source_id, o_orderpriority AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY ALL)"


@query(f"WITH {_MONTHLY.format('month')} SELECT * FROM o")
def slices_monthly(spark: SparkSession, d: str) -> DataFrame:
    return orders_by_month(spark, d).edges.select(F.date_format("slice_end", "yyyy-MM-dd").alias("slice"), "source_id", "target_id", "weight")


@query(f"WITH {_MONTHLY.format('year')} SELECT * FROM o")
def slices_yearly(spark: SparkSession, d: str) -> DataFrame:
    return orders_by_month(spark, d, "yearly").edges.select(F.date_format("slice_end", "yyyy-MM-dd").alias("slice"), "source_id", "target_id", "weight")


_GRID = f"WITH {_MONTHLY.format('year')}, n AS (SELECT source_id AS id FROM o UNION SELECT target_id FROM o), s AS (SELECT DISTINCT slice FROM o), c AS (SELECT slice, id, count(*) AS d FROM (SELECT slice, source_id AS id FROM o UNION ALL SELECT slice, target_id FROM o) GROUP BY ALL), g AS (SELECT n.id, s.slice, CAST(coalesce(d, 0) AS DOUBLE) AS degree FROM n CROSS JOIN s LEFT JOIN c ON c.id = n.id AND c.slice = s.slice)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    g = orders_by_month(spark, d, "yearly")
    return temporal.degree_grid(g.edges, g.edges.select("slice_end").distinct())


@query(_GRID + " SELECT id AS node_id, slice, degree FROM g")
def temporal_degree_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select("node_id", F.date_format("date", "yyyy-MM-dd").alias("slice"), "degree")


@query(_GRID + ", r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY slice) - 1 AS pos FROM g), s2 AS (SELECT id, avg(degree) AS m, coalesce(stddev_samp(degree), 0) AS sd, min(degree) AS lo, max(degree) AS hi, coalesce(regr_slope(degree, pos), 0) AS tr, arg_min(degree, slice) AS f, arg_max(degree, slice) AS l FROM r GROUP BY 1) SELECT id AS node_id, round(m, 6) AS degree_mean, round(sd, 6) AS degree_std, lo AS degree_min, hi AS degree_max, hi - lo AS degree_range, round(tr, 6) AS degree_trend, round(CASE WHEN m = 0 THEN 0 ELSE sd / m END, 6) AS degree_volatility, round(CASE WHEN f <> 0 THEN (l - f) / f * 100 WHEN l = 0 THEN 0.0 ELSE -1.0 END, 6) AS degree_growth_rate FROM s2")
def temporal_stats(spark: SparkSession, d: str) -> DataFrame:
    x = temporal.calculate_temporal_statistics(_grid(spark, d), temporal.STATISTICS)
    finite = F.when(F.col("degree_growth_rate") == float("inf"), F.lit(-1.0)).otherwise(F.col("degree_growth_rate"))
    return r6(x.withColumn("degree_growth_rate", finite))


_CATEGORY = f"WITH {_MONTHLY.format('year')}, m AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS c FROM customer), x AS (SELECT slice, weight, coalesce(a.c, 'unknown') AS ca, coalesce(b.c, 'unknown') AS cb FROM o LEFT JOIN m a ON a.id = source_id LEFT JOIN m b ON b.id = target_id), k AS (SELECT slice, least(ca, cb) AS category_a, greatest(ca, cb) AS category_b, sum(weight) AS s, count(*) AS n FROM x GROUP BY ALL)"


def _category(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), "c_mktsegment")
    return categories.category_connections(orders_by_month(spark, d, "yearly").edges, meta, "c_mktsegment", "sum")


@query(_CATEGORY + " SELECT slice, category_a, category_b, s AS connection_strength, CAST(n AS BIGINT) AS edge_count FROM k")
def category_connections(spark: SparkSession, d: str) -> DataFrame:
    return _category(spark, d).select(F.date_format("date", "yyyy-MM-dd").alias("slice"), "category_a", "category_b", "connection_strength", "edge_count")


@query("WITH x AS (SELECT date_trunc('month', o_orderdate) AS m, a.c_mktsegment AS a, o_orderpriority AS p, o_totalprice AS w FROM orders JOIN customer a ON c_custkey = o_custkey), k AS (SELECT m, left(a, 1) AS ca, left(p, 1) AS cb, w FROM x) SELECT strftime(m, '%Y-%m-%d') AS slice, round(coalesce(sum(w) FILTER (ca < 'C') / nullif(sum(w), 0), 0), 6) AS segregation_index FROM k GROUP BY m")
def segregation_index(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    same = F.when(F.substring("c_mktsegment", 1, 1) < "C", F.lit("x")).otherwise(F.lit("y"))
    k = o.select(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("date"), F.lit("x").alias("category_a"), same.alias("category_b"), F.col("o_totalprice").alias("connection_strength"))
    return r6(categories.calculate_category_segregation_index(k).select(F.col("date").alias("slice"), "segregation_index"))


_METRICS = f"WITH {_MONTHLY.format('year')}, n AS (SELECT source_id AS id FROM o UNION SELECT target_id FROM o), s AS (SELECT DISTINCT CAST(slice AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS date, slice FROM o), k AS (SELECT slice, id, count(*) AS c FROM (SELECT slice, source_id AS id FROM o UNION ALL SELECT slice, target_id FROM o) GROUP BY ALL), m AS (SELECT slice, count(*) - 1 AS m FROM k GROUP BY 1)"


@query(_METRICS + ", v AS (SELECT s.date, c_mktsegment AS category, c / m AS v FROM k JOIN m USING (slice) JOIN s USING (slice) LEFT JOIN customer ON 'c' || c_custkey = id) SELECT date, coalesce(category, 'unknown') AS category, round(avg(v), 6) AS mean_centrality, round(median(v), 6) AS median_centrality, round(max(v), 6) AS max_centrality, CAST(count(*) AS BIGINT) AS node_count FROM v GROUP BY ALL")
def category_centrality(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), "c_mktsegment")
    return r6(categories.analyze_category_centrality_by_time(orders_by_month(spark, d, "yearly"), meta, "c_mktsegment"))


@query(_METRICS + " SELECT n.id AS node_id, s.date, round(coalesce(c / m, 0), 6) AS degree FROM n CROSS JOIN s LEFT JOIN k ON k.id = n.id AND k.slice = s.slice LEFT JOIN m ON m.slice = s.slice")
def temporal_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r6(temporal.extract_temporal_metrics(orders_by_month(spark, d, "yearly"), ["degree"]))


# Posts.


def linked(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold each page's address twice, with other things around."""
    p = table(spark, d, "pages")
    return p.select((F.col("page_id") % 50).alias("sender"), F.concat(F.lit("See "), "url", F.lit(" and "), "url", F.lit(".")).alias("post"), F.lit(None).cast("timestamp").alias("datetime"))



@query(r"SELECT page_id % 50 AS sender, lower(regexp_extract(url, '^(?:https?://)?(?:www\.)?([^/?#:]+)', 1)) AS domain, CAST(count(*) AS BIGINT) AS n FROM pages WHERE regexp_matches(url, '^(?:https?://|www\.)') GROUP BY ALL")
def domains(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_domains(linked(spark, d)).groupBy("sender", "domain").agg(F.count("*").alias("n"))


_TRACKED = "(?:" + "|".join(sorted(TRACKING, key=len, reverse=True)) + ")=[^&#]*"
_PLAIN = "url"
for _pattern, _new in (("amp%3B|amp;", ""), (rf"\?(?:{_TRACKED}&)+", "?"), (rf"\?{_TRACKED}", "?"), (rf"&{_TRACKED}", ""), (r"\?#", "#"), (r"\?$", ""), ("&$", ""), (r"[.,;:!?)\]}>]+$", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_new}', 'g')"


@query(f"SELECT page_id % 50 AS sender, {_PLAIN} AS url FROM pages WHERE regexp_matches(url, '^(?:https?://|www[.])')")
def urls(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_urls(linked(spark, d)).select("sender", "url")


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("role").alias("sender"), F.col("text").alias("post"), F.col("conv_id").alias("datetime"))


_TOKENS = r"t AS (SELECT role AS sender, conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS keyword FROM conversations)"


@query(f"WITH {_TOKENS} SELECT sender, keyword, CAST(count(*) AS BIGINT) AS mentions, min(conv_id) AS first_seen FROM t GROUP BY ALL")
def keywords_agg(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_keywords(posts(spark, d))


@query(f"WITH {_TOKENS} SELECT sender, conv_id AS datetime, keyword FROM t WHERE length(keyword) >= 6")
def keywords_long(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_keywords(posts(spark, d), output="long", min_word_length=6)


@query(f"WITH {_TOKENS} SELECT sender, keyword, CAST(count(*) AS BIGINT) AS mentions, min(conv_id) AS first_seen FROM t WHERE keyword IN ('the', 'of', 'le', 'un') GROUP BY ALL")
def keywords_vocab(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_keywords(posts(spark, d), ["the", "Of", "le", "un"])


_RAKE = r"""WITH s AS (SELECT role AS sender, conv_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]+')) AS seg FROM conversations),
w AS (SELECT sender, conv_id, list_transform(regexp_extract_all(seg, '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: CASE WHEN x IN ('the', 'of', 'le', 'un') THEN '|' ELSE x END) AS ws FROM s),
c AS (SELECT sender, conv_id, unnest(list_filter(list_transform(string_split(array_to_string(ws, ' '), '|'), lambda x: trim(x)), lambda x: x <> '')) AS keyword FROM w),
n AS (SELECT sender, keyword, count(*) AS mentions, min(conv_id) AS first_seen FROM c GROUP BY ALL),
t AS (SELECT keyword, sum(mentions) AS n, len(string_split(keyword, ' ')) AS l FROM n GROUP BY 1),
u AS (SELECT keyword, n, l, unnest(string_split(keyword, ' ')) AS w FROM t),
d AS (SELECT w, sum(n * l) / sum(n) AS s FROM u GROUP BY 1),
g AS (SELECT keyword, sum(s) AS score FROM u JOIN d USING (w) GROUP BY 1),
r AS (SELECT sender, keyword, mentions, first_seen, score, row_number() OVER (PARTITION BY sender ORDER BY len(string_split(keyword, ' ')) <= 3 DESC, round(score, 9) DESC, mentions DESC, keyword) AS k FROM n JOIN g USING (keyword))
SELECT sender, keyword, CAST(mentions AS BIGINT) AS mentions, first_seen FROM r WHERE k <= 20"""


@query(_RAKE)
def rake_topn(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_keywords(posts(spark, d), method="rake", top_n=20, stop_words=["the", "of", "le", "un"])


# Embeddings.

_DIM = "x AS (SELECT label AS sender, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS dim, vec_id FROM embeddings)"


def _features(aggregation: str, **kwargs: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "embeddings").select(F.col("label").alias("sender"), F.col("embedding").alias("e"), F.lit("").alias("post"))
        options = {"embedding_col": "e", "datetime_col": None, "normalize_embeddings": False, "aggregation": aggregation, "weight_transform": "raw"} | kwargs
        return r6(embed.extract_embedding_features(v, **options).select("sender", "feature", "weight"))

    return run


for _name, _how in (("mean", "avg"), ("sum", "sum"), ("max", "max")):
    query(f"WITH {_DIM} SELECT sender, 'dim_' || dim AS feature, round({_how}(CAST(v AS DOUBLE)), 6) AS weight FROM x GROUP BY sender, dim", f"embedding_features_{_name}")(_features(_name))
query(f"WITH {_DIM}, m AS (SELECT sender, dim, round(avg(CAST(v AS DOUBLE)) + 2, 12) AS w FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY w DESC, dim) AS k FROM m WHERE w >= 1.9) SELECT sender, 'dim_' || dim AS feature, round(w, 6) AS weight FROM r WHERE k <= 5", "embedding_topk")(_features("mean", weight_transform="shift", min_weight=1.9, top_k=5))


def _knn(mutual: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e"), F.lit("").alias("post"))
        e = embed.extract_embedding_similarity_edgelist(v, sender_col="vec_id", embedding_col="e", k=5, similarity_threshold=-1.0, mutual=mutual)
        return r6(e)

    return run


_KNN = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s), p AS (SELECT least(a, b) AS source, greatest(a, b) AS target, round(max(s), 6) AS weight, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL) SELECT source, target, weight FROM p"
query(_KNN, "cosine_knn_union")(_knn(False))
query(_KNN + " WHERE n = 2", "cosine_knn_mutual")(_knn(True))


# Pipelines.


_ROWS = SHARES.replace("shares AS", "raw AS")
#: Half of the rows by their p-value, which rises with the product of both ends' rows, then by ids.
_VALID = f"{_ROWS}, su AS (SELECT source, count(*) AS c FROM raw GROUP BY 1), sv AS (SELECT target, count(*) AS c FROM raw GROUP BY 1), rk AS (SELECT source, target, row_number() OVER (ORDER BY su.c * sv.c, source, target) AS r FROM raw JOIN su USING (source) JOIN sv USING (target)), kp AS (SELECT DISTINCT source, target FROM rk WHERE r <= ceil((SELECT count(*) FROM raw) * 0.5)), shares AS (SELECT * FROM raw SEMI JOIN kp USING (source, target))"
_CANONICAL = _TEMPORAL.replace(f"WITH {SHARES}", _VALID) + ", e AS (SELECT a.p AS source_id, b.p AS target_id, CAST(count(*) AS DOUBLE) AS weight FROM r a JOIN r b ON a.i = b.i AND a.k < b.k AND a.p <> b.p GROUP BY ALL)"


@query(_NCD.replace(SUMMED, _CANONICAL) + f" SELECT {_EW} FROM s WHERE score - sd > 0")
def pipeline_canonical(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.run_canonical_pipeline(shares(spark, d), source_col="source", target_col="target", timestamp_col="ts", bipartite_target_fraction=0.5, verbose=False)
    return r6(out.edgelist.frame(out.id_mapper))


_JACCARD = f"{_VALID}, sp AS (SELECT DISTINCT source AS p, target AS s FROM shares), c AS (SELECT a.p AS source_id, b.p AS target_id, count(*) AS n FROM sp a JOIN sp b ON a.s = b.s AND a.p < b.p GROUP BY ALL), g AS (SELECT p, count(*) AS d FROM sp GROUP BY 1), e AS (SELECT source_id, target_id, n / (x.d + y.d - n) AS weight FROM c JOIN g x ON x.p = source_id JOIN g y ON y.p = target_id)"


@query(_NCU.replace(SUMMED, _JACCARD) + f" SELECT {_EW} FROM s WHERE score - 0.1 * sd > 0")
def pipeline_bipartite(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.run_undirected_bipartite_pipeline(shares(spark, d), source_col="source", target_col="target", bipartite_target_fraction=0.5, projection_threshold=0.1, verbose=False)
    return r6(out.edgelist.frame(out.id_mapper))


@query(_NCU.replace(SUMMED, PEERS) + f" SELECT {_EW} FROM s WHERE score - sd > 0")
def pipeline_unipartite(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.run_undirected_unipartite_pipeline(peers(spark, d), source_col="source_id", target_col="target_id", verbose=False)
    return r6(out.edgelist.frame(out.id_mapper))
