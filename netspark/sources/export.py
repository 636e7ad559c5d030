"""Graphs as files: GEXF, GraphML, CSV edge lists, Parquet."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper
from netspark.errors import ComputationError, ValidationError, validate_parameter
from netspark.operators.centrality import METRICS, extract_centrality
from netspark.operators.reduce import reduce_by_grouping, reduce_by_influence, reduce_by_sampling

log = logging.getLogger("netspark.export")
FORMATS = ["gexf", "graphml", "edgelist", "parquet"]


def node_table(graph: EdgeList, id_mapper: IDMapper, metadata: DataFrame | None = None, include_metrics: list[str] | None = None) -> DataFrame:
    """``node_id`` of every node with its centralities and metadata."""
    nodes = id_mapper.nodes.select("node_id")
    if include_metrics:
        nodes = nodes.join(extract_centrality(graph, id_mapper, include_metrics), "node_id", "left")
    if metadata is not None:
        nodes = nodes.join(metadata.dropDuplicates(["node_id"]), "node_id", "left")
    return nodes


def edge_table(graph: EdgeList, id_mapper: IDMapper, nodes: DataFrame | None = None) -> DataFrame:
    """``source, target, weight`` in original ids; with nodes also their attributes as source_* and target_*."""
    edges = graph.frame(id_mapper).toDF("source", "target", "weight")
    attributes = [] if nodes is None else [c for c in nodes.columns if c != "node_id"]
    for end in ("source", "target") if attributes else ():
        side = nodes.select(F.col("node_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in attributes])
        edges = edges.join(side, end, "left")
    return edges.select("source", "target", "weight", *[f"{end}_{c}" for end in ("source", "target") for c in attributes])


def _attribute(x: Any) -> str:
    return quoteattr("" if x is None else str(x))


def _gexf(graph: EdgeList, nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    names = [c for c in nodes.columns if c != "node_id"]
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n'
    yield f'  <graph mode="static" defaultedgetype="{"directed" if graph.directed else "undirected"}">\n'
    if names:
        yield '    <attributes class="node">\n'
        for i, c in enumerate(names):
            yield f'      <attribute id="{i}" title={_attribute(c)} type="string"/>\n'
        yield "    </attributes>\n"
    yield "    <nodes>\n"
    for r in nodes.toLocalIterator(prefetchPartitions=True):
        yield f"      <node id={_attribute(r['node_id'])} label={_attribute(r['node_id'])}>"
        if names:
            yield "<attvalues>" + "".join(f'<attvalue for="{i}" value={_attribute(r[c])}/>' for i, c in enumerate(names) if r[c] is not None) + "</attvalues>"
        yield "</node>\n"
    yield "    </nodes>\n    <edges>\n"
    for i, r in enumerate(edges.toLocalIterator(prefetchPartitions=True)):
        weight = f' weight="{r["weight"]}"' if graph.is_weighted() else ""
        yield f'      <edge id="{i}" source={_attribute(r["source"])} target={_attribute(r["target"])}{weight}/>\n'
    yield "    </edges>\n  </graph>\n</gexf>\n"


def _graphml(graph: EdgeList, nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    names = [c for c in nodes.columns if c != "node_id"]
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    for i, c in enumerate(names):
        yield f'  <key id="n{i}" for="node" attr.name={_attribute(c)} attr.type="string"/>\n'
    if graph.is_weighted():
        yield '  <key id="w" for="edge" attr.name="weight" attr.type="double"/>\n'
    yield f'  <graph edgedefault="{"directed" if graph.directed else "undirected"}">\n'
    for r in nodes.toLocalIterator(prefetchPartitions=True):
        data = "".join(f'<data key="n{i}">{escape(str(r[c]))}</data>' for i, c in enumerate(names) if r[c] is not None)
        yield f"    <node id={_attribute(r['node_id'])}>{data}</node>\n"
    for r in edges.toLocalIterator(prefetchPartitions=True):
        data = f'<data key="w">{r["weight"]}</data>' if graph.is_weighted() else ""
        yield f"    <edge source={_attribute(r['source'])} target={_attribute(r['target'])}>{data}</edge>\n"
    yield "  </graph>\n</graphml>\n"


def target_path(output_path: str, format: str) -> Path:
    path = Path(output_path)
    return path if path.suffix else path.with_suffix(".csv" if format == "edgelist" else f".{format}")


def export_graph(graph: EdgeList, id_mapper: IDMapper, output_path: str, format: str = "gexf", metadata: DataFrame | None = None, include_metrics: list[str] | None = None, overwrite: bool = False) -> None:
    """Write a graph. XML is one file, streamed partition by partition through the driver; edge lists (CSV with header) and Parquet (``{base}_nodes.parquet``, ``{base}_edges.parquet``) are folders that tasks write. An existing target is replaced, with a warning unless overwrite."""
    if format not in FORMATS:
        raise ValidationError(f"unknown format {format!r}", field="format", value=format, expected=str(FORMATS))
    if not output_path or not isinstance(output_path, str):
        raise ValidationError("output_path must be a string", field="output_path", value=output_path)
    if metadata is not None and "node_id" not in metadata.columns:
        raise ValidationError("metadata lack node_id", field="metadata", value=metadata.columns)
    if bad := [m for m in include_metrics or [] if m not in METRICS]:
        raise ValidationError(f"unknown metrics {bad}", field="include_metrics", value=bad, expected=str(METRICS))
    path = target_path(output_path, format)
    if path.exists() and not overwrite:
        log.warning("%s exists and is replaced", path)
    nodes = node_table(graph, id_mapper, metadata, include_metrics)
    try:
        if format == "edgelist":
            edge_table(graph, id_mapper, nodes).write.mode("overwrite").csv(str(path), header=True)
        elif format == "parquet":
            base = str(path.with_suffix(""))
            nodes.write.mode("overwrite").parquet(f"{base}_nodes.parquet")
            edge_table(graph, id_mapper).write.mode("overwrite").parquet(f"{base}_edges.parquet")
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            with path.open("w", encoding="utf-8") as out:
                out.writelines((_gexf if format == "gexf" else _graphml)(graph, nodes, edge_table(graph, id_mapper)))
    except OSError as error:
        raise ComputationError(f"the graph was not exported: {error}", operation="export_graph") from error


def get_export_info(graph: EdgeList, id_mapper: IDMapper, metadata: DataFrame | None = None, include_metrics: list[str] | None = None) -> dict[str, Any]:
    """What export_graph() would write: counts, attributes, nodes without metadata, rough sizes in bytes."""
    n, m = id_mapper.size(), graph.number_of_edges()
    attributes = [f"{x}_centrality" for x in include_metrics or []] + ([c for c in metadata.columns if c != "node_id"] if metadata is not None else [])
    missing = id_mapper.nodes.join(metadata, "node_id", "left_anti").count() if metadata is not None else 0
    base, extra = 50 * n + 30 * m, 20 * n * len(attributes)
    sizes = {"gexf": base + 3 * extra, "graphml": base + 3 * extra, "edgelist": base + extra, "parquet": 0.3 * (base + extra)}
    return {"graph_info": {"nodes": n, "edges": m, "directed": graph.directed, "weighted": graph.is_weighted()}, "export_attributes": attributes, "missing_metadata_nodes": missing, "estimated_sizes": sizes}


def export_reduced_graph(graph: EdgeList, id_mapper: IDMapper, output_path: str, method: str, *, glp_results: Any = None, glp_direction: str = "both", format: str = "gexf", extra_metadata: DataFrame | None = None, overwrite: bool = False, return_reduced: bool = False, **method_kwargs: Any) -> Any:
    """Reduce by ``grouping``, ``influence`` or ``sampling`` and export with all attributes; the path, and with return_reduced also what was written."""
    how = {"grouping": reduce_by_grouping, "influence": reduce_by_influence, "sampling": reduce_by_sampling}
    validate_parameter(method, list(how), "method")
    if extra_metadata is not None and "node_id" not in extra_metadata.columns:
        raise ValidationError("extra_metadata lack node_id", field="extra_metadata", value=extra_metadata.columns)
    small, mapper, attributes = how[method](graph, id_mapper, glp_results=glp_results, glp_direction=glp_direction, **method_kwargs)
    if extra_metadata is not None:
        attributes = attributes.join(extra_metadata, "node_id", "left")
    export_graph(small, mapper, str(output_path), format, attributes, overwrite=overwrite)
    path = target_path(str(output_path), format)
    return (path, small, mapper, attributes) if return_reduced else path
