"""Edge lists from raw rows."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, dense_codes, from_frame
from netspark.errors import GraphConstructionError, ValidationError, validate_parameter
from netspark.operators.components import connected_components
from netspark.operators.validators import validate_edgelist_dataframe
from netspark.session import checkpointed, released, small
from netspark.sources.load import load_edges

log = logging.getLogger("netspark.construct")


def process_edges(df: DataFrame, source_col: str, target_col: str, weight_col: str | None, auto_weight: bool, allow_self_loops: bool, remove_duplicates: bool, order_by: list[str] | None = None) -> DataFrame:
    """Self-loops go unless allowed; then duplicates are counted (auto_weight without a weight column), summed (with one), or cut to the first.

    The first duplicate is that of the least order_by, by default of the least
    of all other columns, since rows of a table have no order of their own.
    """
    if not allow_self_loops:
        df = df.where(F.col(source_col) != F.col(target_col))
    pair = [source_col, target_col]
    if weight_col is None and auto_weight:
        return df.groupBy(*pair).agg(F.count("*").cast("double").alias("weight"))
    if weight_col is not None and not remove_duplicates:
        return df.groupBy(*pair).agg(F.sum(F.col(weight_col).cast("double")).alias("weight"))
    if remove_duplicates:
        rest = order_by or [c for c in df.columns if c not in pair]
        first = Window.partitionBy(*pair).orderBy(*[F.col(c).asc_nulls_last() for c in rest] or [F.lit(1)])
        df = df.withColumn("__row", F.row_number().over(first)).where("__row = 1").drop("__row")
    if weight_col is not None and weight_col != "weight":
        df = df.withColumn("weight", F.col(weight_col).cast("double")).drop(weight_col)
    return df


def apply_min_degree_filter(df: DataFrame, source_col: str, target_col: str, min_source_degree: int | None, min_target_degree: int | None) -> DataFrame:
    """Rows whose source and target occur in at least so many rows of the input; applied once."""
    out = df
    for column, least in ((source_col, min_source_degree), (target_col, min_target_degree)):
        if least is not None and least > 1:
            enough = df.groupBy(column).count().where(F.col("count") >= least).select(F.col(column).alias("__enough"))
            out = out.join(enough, out[column] == enough["__enough"], "left_semi")
    return out


def apply_bipartite_overlap_policy(df: DataFrame, source_col: str, target_col: str, policy: str) -> DataFrame:
    """Ids that are both source and target: raise, drop their edges, or only warn."""
    validate_parameter(policy, ["raise", "drop", "warn"], "bipartite_overlap")
    both = df.select(F.col(source_col).alias("__both")).intersect(df.select(F.col(target_col).alias("__both")))
    if policy == "drop":
        for column in (source_col, target_col):
            df = df.join(both, df[column] == both["__both"], "left_anti")
        return df
    some = [r[0] for r in both.limit(5).collect()]
    if some and policy == "raise":
        raise ValidationError("ids occur as source and as target of bipartite edges", field="bipartite", value=some)
    if some:
        log.warning("ids occur as source and as target of bipartite edges: %s", some)
    return df


def build_edgelist_from_frame(edgelist: str | Path | DataFrame, source_col: str = "source", target_col: str = "target", weight_col: str | None = None, directed: bool = False, bipartite: bool = False, auto_weight: bool = True, allow_self_loops: bool = True, remove_duplicates: bool = False, bipartite_overlap: str = "raise", min_source_degree: int | None = None, min_target_degree: int | None = None, code_dtype: str = "bigint", passthrough_cols: Iterable[str] | None = None, verbose: bool = True, streaming: bool = False, spark: SparkSession | None = None) -> tuple[EdgeList, IDMapper]:
    """Edge list in dense codes and its mapper.

    Rows with a null source, target or weight are dropped. (a, b) and (b, a)
    stay apart, also undirected. The list is weighted if a weight column is
    named or some pair occurs twice. passthrough_cols come along if rows are
    neither counted nor merged. streaming is accepted and means nothing here.
    """
    df = load_edges(edgelist, spark)
    extra = list(passthrough_cols or [])
    needed = [source_col, target_col, *([weight_col] if weight_col else []), *extra]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValidationError(f"columns are missing: {missing}", field="edgelist", expected=str(needed), value=df.columns)
    if extra and (auto_weight and weight_col is None or weight_col is not None and not remove_duplicates or remove_duplicates):
        raise ValidationError("passthrough_cols need rows that are neither aggregated nor deduplicated", field="passthrough_cols", value=extra)
    if source_col == target_col:
        raise ValidationError("source and target must be different columns", field="target_col", value=target_col)
    for name, least in (("min_source_degree", min_source_degree), ("min_target_degree", min_target_degree)):
        if least is not None and least < 1:
            raise ValidationError(f"{name} must be at least 1", field=name, value=least)
    df = df.select(*dict.fromkeys(needed)).dropna(subset=[source_col, target_col, *([weight_col] if weight_col else [])])
    validate_edgelist_dataframe(df, source_col, target_col, weight_col)
    df = process_edges(df, source_col, target_col, weight_col, auto_weight, allow_self_loops, remove_duplicates)
    if bipartite:
        df = apply_bipartite_overlap_policy(df, source_col, target_col, bipartite_overlap)
    df = apply_min_degree_filter(df, source_col, target_col, min_source_degree, min_target_degree)
    renamed = checkpointed(df.withColumnsRenamed({source_col: "source_id", target_col: "target_id"}))
    plain = weight_col is None and auto_weight and renamed.where("weight > 1").isEmpty()
    el, mapper = from_frame(renamed.drop("weight") if plain else renamed, directed, bipartite, extra=extra)
    released(renamed)
    if bipartite:
        sides = [el.df.select(F.col(c).alias("code")).distinct().withColumn(flag, F.lit(True)) for c, flag in (("src", "is_source"), ("tgt", "is_target"))]
        nodes = mapper.nodes.join(sides[0], "code", "left").join(sides[1], "code", "left")
        mapper = IDMapper(checkpointed(nodes.select("node_id", "code", F.coalesce("is_source", F.lit(False)).alias("is_source"), F.coalesce("is_target", F.lit(False)).alias("is_target"))))
    return el, mapper


def build_graph_from_edgelist(edgelist: str | Path | DataFrame, source_col: str = "source", target_col: str = "target", weight_col: str | None = None, directed: bool = False, bipartite: bool = False, auto_weight: bool = True, allow_self_loops: bool = True, remove_duplicates: bool = False, bipartite_overlap: str = "raise", chunk_size: int | None = None, min_source_degree: int | None = None, min_target_degree: int | None = None, verbose: bool = True, spark: SparkSession | None = None) -> tuple[EdgeList, IDMapper]:
    """Like build_edgelist_from_frame(): a graph is its edge list. chunk_size means nothing here."""
    return build_edgelist_from_frame(edgelist, source_col, target_col, weight_col, directed, bipartite, auto_weight, allow_self_loops, remove_duplicates, bipartite_overlap, min_source_degree, min_target_degree, verbose=verbose, spark=spark)


def edgelist_to_graph(edge_list: EdgeList, id_mapper: IDMapper, chunk_size: int | None = None) -> EdgeList:
    """The same object: graphs are edge lists."""
    return edge_list


def graph_to_edgelist(graph: EdgeList, id_mapper: IDMapper, code_dtype: str = "bigint") -> EdgeList:
    """The graph, bipartite if its mapper records sides."""
    return graph.with_df(graph.df, bipartite=id_mapper.has_bipartite_partitions())


def graph_to_edges(graph: EdgeList, id_mapper: IDMapper) -> DataFrame:
    """``source_id, target_id, weight`` in original ids."""
    return graph.frame(id_mapper)


def induced(graph: EdgeList, id_mapper: IDMapper, keep: DataFrame) -> tuple[EdgeList, IDMapper]:
    """Subgraph of the nodes in keep (code), with dense codes in the old order."""
    keep = checkpointed(keep.select("code").distinct())
    nodes = id_mapper.nodes.join(keep, "code", "left_semi")
    new = small(checkpointed(dense_codes(nodes, "code").toDF("code", "__new")))
    edges = graph.df
    for c in ("src", "tgt"):
        side = new.select(F.col("code").alias("__old"), F.col("__new").alias("__" + c))
        edges = edges.join(side, edges[c] == side["__old"]).drop("__old", c)
    others = [c for c in graph.df.columns if c not in ("src", "tgt")]
    coded = edges.select(F.col("__src").alias("src"), F.col("__tgt").alias("tgt"), *others)
    renumbered = nodes.join(new, "code").drop("code").withColumnRenamed("__new", "code")
    return graph.with_df(coded, n_nodes=None), IDMapper(renumbered.select("node_id", "code", *[c for c in nodes.columns if c.startswith("is_")]))


def get_graph_info(graph: EdgeList, id_mapper: IDMapper) -> dict:
    n = id_mapper.size()
    m, loops = graph.df.agg(F.count("*"), F.coalesce(F.sum((F.col("src") == F.col("tgt")).cast("long")), F.lit(0))).first()
    possible = n * (n - 1) / (1 if graph.directed else 2)
    parts = connected_components(graph.weighted().toDF("source_id", "target_id", "weight"), id_mapper.nodes.select(F.col("code").alias("node_id"))).select("component").distinct().count()
    return {"num_nodes": n, "num_edges": m, "directed": graph.directed, "weighted": graph.is_weighted(), "self_loops": loops, "density": m / possible if possible else 0.0, "is_connected": parts == 1}


def get_bipartite_info(graph: EdgeList, id_mapper: IDMapper) -> dict:
    """Sizes of both sides, recorded or found by two-colouring; ``is_bipartite`` False for an odd cycle."""
    nodes = partitions(graph, id_mapper)
    if nodes is None:
        return {"is_bipartite": False}
    s, t = nodes.agg(F.count_if("is_source"), F.count_if("is_target")).first()
    return {"is_bipartite": True, "source_partition_size": s, "target_partition_size": t, "nodes": nodes}


def partitions(graph: EdgeList, id_mapper: IDMapper) -> DataFrame | None:
    """``node_id, code, is_source, is_target``: the recorded sides, or a two-colouring in which the least node of each component is a source; None if an odd cycle forbids it.

    Components of the double cover tell: a graph is bipartite unless both
    copies of some node are connected.
    """
    if id_mapper.has_bipartite_partitions():
        return id_mapper.nodes
    e = graph.weighted().select("src", "tgt")
    double = e.select((F.col("src") * 2).alias("source_id"), (F.col("tgt") * 2 + 1).alias("target_id")).union(e.select((F.col("src") * 2 + 1), (F.col("tgt") * 2)))
    cover = id_mapper.nodes.select(F.explode(F.array(F.col("code") * 2, F.col("code") * 2 + 1)).alias("node_id"))
    parts = connected_components(double, cover)
    sides = parts.groupBy(F.floor(F.col("node_id") / 2).cast("long").alias("code")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "node_id").alias("own"))
    if not sides.where("lo = hi").isEmpty():
        return None
    first = F.min("lo").over(Window.partitionBy("lo"))
    return id_mapper.nodes.select("node_id", "code").join(sides.select("code", (F.col("own") == first).alias("is_source")), "code").select("node_id", "code", "is_source", (~F.col("is_source")).alias("is_target"))


def validate_graph_construction(graph: EdgeList, id_mapper: IDMapper, expected_nodes: int | None = None, expected_edges: int | None = None) -> bool:
    """Raise if counts differ from what is expected or a code has no id."""
    n, m = id_mapper.size(), graph.number_of_edges()
    if expected_nodes is not None and n != expected_nodes:
        raise GraphConstructionError(f"expected {expected_nodes} nodes, found {n}", node_count=n)
    if expected_edges is not None and m != expected_edges:
        raise GraphConstructionError(f"expected {expected_edges} edges, found {m}", edge_count=m)
    unknown = graph.df.select(F.explode(F.array("src", "tgt")).alias("code")).join(id_mapper.nodes.select("code"), "code", "left_anti")
    if not unknown.isEmpty():
        raise GraphConstructionError("edges have codes without an id", operation="validate")
    return True

