"""Edge lists in codes and the table that maps codes to original ids."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.errors import ValidationError
from netspark.session import checkpointed, released

log = logging.getLogger("netspark.edges")

#: Ids that one window numbers.
RANGE = 1_000_000


def dense_codes(ids: DataFrame, column: str) -> DataFrame:
    """``node_id, code`` with codes 0.. in the order of distinct ids.

    Sampled quantiles cut the ids into ranges; each range is numbered by its own
    window and shifted by the sizes of the ranges before it, so nothing is
    sorted on one machine.
    """
    distinct = ids.select(F.col(column).alias("node_id")).where("node_id IS NOT NULL").distinct()
    cuts = _cuts(distinct)
    if not cuts:
        return distinct.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("long").alias("code"))
    kind = distinct.schema["node_id"].dataType
    part = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col("node_id")))
    ranged = distinct.withColumn("part", part)
    row = F.row_number().over(Window.partitionBy("part").orderBy("node_id"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return ranged.withColumn("row", row).join(F.broadcast(first), "part").select("node_id", (F.col("first") + F.col("row") - 1).cast("long").alias("code"))


def _cuts(distinct: DataFrame) -> list:
    """Borders of about RANGE ids each; none if one range is enough."""
    n = distinct.count()
    if n <= RANGE:
        return []
    parts = -(-n // RANGE)
    sample = sorted(r[0] for r in distinct.sample(min(1.0, 20 * parts / n), 7).collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


class IDMapper:
    """Original ids and dense codes, as a table ``node_id, code[, is_source, is_target]``."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def from_originals(cls, originals: Iterable[Any], spark: SparkSession | None = None) -> IDMapper:
        """Codes in the given order; repeated ids are an error."""
        items = list(originals)
        if len(set(items)) != len(items):
            raise ValidationError("original ids must be distinct", field="originals")
        spark = spark or SparkSession.active()
        kind = "bigint" if items and all(isinstance(x, int) for x in items) else "double" if items and all(isinstance(x, float) for x in items) else "string"
        return cls(spark.createDataFrame([(x, i) for i, x in enumerate(items)], f"node_id {kind}, code bigint"))

    @classmethod
    def from_dict(cls, mapping: Mapping[str, Any], spark: SparkSession | None = None) -> IDMapper:
        """From to_dict(); the two directions must agree."""
        forward = mapping["original_to_internal"]
        back = {int(k): v for k, v in mapping["internal_to_original"].items()}
        if len(forward) != len(back) or any(back.get(c) != i for i, c in forward.items()):
            raise ValidationError("the mapping's two directions disagree", field="mapping")
        ordered = cls.from_originals([back[c] for c in sorted(back)], spark)
        if sorted(back) != list(range(len(back))):
            return cls(ordered.nodes.sparkSession.createDataFrame([(back[c], c) for c in sorted(back)], ordered.nodes.schema))
        return ordered

    def to_dict(self) -> dict[str, dict]:
        rows = self.nodes.select("node_id", "code").collect()
        return {"original_to_internal": {r[0]: r[1] for r in rows}, "internal_to_original": {r[1]: r[0] for r in rows}}

    def get_internal(self, original_id: Any) -> int:
        row = self.nodes.where(self._is(original_id)).select("code").first()
        if row is None:
            raise KeyError(original_id)
        return row[0]

    def get_original(self, internal_id: int) -> Any:
        if not isinstance(internal_id, int) or isinstance(internal_id, bool):
            raise TypeError("internal ids are integers")
        row = self.nodes.where(F.col("code") == internal_id).select("node_id").first()
        if row is None:
            raise KeyError(internal_id)
        return row[0]

    def get_internal_batch(self, original_ids: Iterable[Any]) -> list[int]:
        wanted = list(original_ids)
        found = {r[0]: r[1] for r in self.nodes.where(F.col("node_id").isin(wanted)).select("node_id", "code").collect()} if wanted else {}
        if missing := [x for x in wanted if x not in found]:
            raise KeyError(missing[0])
        return [found[x] for x in wanted]

    def get_original_batch(self, internal_ids: Iterable[int]) -> list[Any]:
        wanted = list(internal_ids)
        found = {r[0]: r[1] for r in self.nodes.where(F.col("code").isin(wanted)).select("code", "node_id").collect()} if wanted else {}
        if missing := [x for x in wanted if x not in found]:
            raise KeyError(missing[0])
        return [found[x] for x in wanted]

    def _is(self, original_id: Any) -> Column:
        """Whether a row has the id, compared as the ids' own type."""
        return F.col("node_id") == F.lit(original_id).try_cast(self.nodes.schema["node_id"].dataType)

    def encode(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """df with the code of a column's ids; rows with unknown ids go."""
        side = self.nodes.select(F.col("node_id").alias("__id"), F.col("code").alias(to))
        return df.join(side, df[column] == side["__id"]).drop("__id")

    def decode(self, df: DataFrame, column: str, to: str) -> DataFrame:
        """df with the original id of a column's codes."""
        side = self.nodes.select(F.col("code").alias("__code"), F.col("node_id").alias(to))
        return df.join(side, df[column] == side["__code"]).drop("__code")

    def add_mapping(self, original_id: Any, internal_id: int) -> None:
        clash = self.nodes.where((self._is(original_id)) | (F.col("code") == internal_id)).select("node_id", "code").collect()
        if clash and any((r[0], r[1]) != (original_id, internal_id) for r in clash):
            raise ValidationError("id or code is already mapped", field="mapping", value=(original_id, internal_id))
        if not clash:
            new = self.nodes.sparkSession.createDataFrame([(original_id, internal_id)], "node_id " + self.nodes.schema["node_id"].dataType.simpleString() + ", code bigint")
            self.nodes = self.nodes.unionByName(new, allowMissingColumns=True)

    def set_bipartite_partitions(self, source_originals: Iterable[Any] | DataFrame, target_originals: Iterable[Any] | DataFrame) -> None:
        """Record both sides; an id on both is a ValueError."""
        sides = []
        for ids in (source_originals, target_originals):
            if isinstance(ids, DataFrame):
                sides.append(ids.select(F.col(ids.columns[0]).alias("node_id")).distinct())
            else:
                sides.append(self.nodes.sparkSession.createDataFrame([(x,) for x in ids], "node_id " + self.nodes.schema["node_id"].dataType.simpleString()).distinct())
        if not sides[0].join(sides[1], "node_id").isEmpty():
            raise ValueError("an id cannot be on both sides")
        nodes = self.nodes.select("node_id", "code")
        for name, side in zip(("is_source", "is_target"), sides, strict=True):
            nodes = nodes.join(side.withColumn(name, F.lit(True)), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        self.nodes = nodes

    def has_bipartite_partitions(self) -> bool:
        return "is_source" in self.nodes.columns

    def has_original(self, original_id: Any) -> bool:
        return not self.nodes.where(self._is(original_id)).isEmpty()

    def has_internal(self, internal_id: int) -> bool:
        return not self.nodes.where(F.col("code") == internal_id).isEmpty()

    def size(self) -> int:
        return self.nodes.count()

    def __len__(self) -> int:
        return self.size()

    def __contains__(self, x: Any) -> bool:
        return self.has_original(x) or (isinstance(x, int) and self.has_internal(x))

    def is_empty(self) -> bool:
        return self.nodes.isEmpty()

    def clear(self) -> None:
        """Drop all mappings; recorded sides stay part of the schema."""
        self.nodes = self.nodes.limit(0)


@dataclass
class EdgeList:
    """Edges ``src, tgt[, weight, …]`` in codes; also what this library calls a graph."""

    df: DataFrame
    directed: bool = False
    bipartite: bool = False
    n_nodes: int | None = None
    #: The rows ``s, p`` of which an undirected graph is the projection by count, if it is one; its edges are then made when they are read.
    factor: DataFrame | None = None

    def __post_init__(self) -> None:
        types = dict(self.df.dtypes)
        for c in ("src", "tgt"):
            if types.get(c) not in ("bigint", "int"):
                raise ValidationError(f"column {c} must hold integer codes", field=c, value=types.get(c))
        if "weight" in types and types["weight"] != "double":
            raise ValidationError("weight must be a double", field="weight", value=types["weight"])

    def number_of_edges(self) -> int:
        return self.df.count()

    def number_of_nodes(self) -> int:
        if self.n_nodes is None:
            self.n_nodes = self.df.select(F.col("src").alias("n")).union(self.df.select("tgt")).distinct().count()
        return self.n_nodes

    def is_weighted(self) -> bool:
        return "weight" in self.df.columns

    def weighted(self) -> DataFrame:
        """``src, tgt, weight`` with weight 1 where there is none."""
        w = F.col("weight") if self.is_weighted() else F.lit(1.0)
        return self.df.select("src", "tgt", w.alias("weight"))

    def frame(self, mapper: IDMapper | None = None) -> DataFrame:
        """``source_id, target_id, weight`` in original ids, or in codes without a mapper."""
        if mapper is None:
            return self.weighted().toDF("source_id", "target_id", "weight")
        x = mapper.decode(mapper.decode(self.weighted(), "src", "source_id"), "tgt", "target_id")
        return x.select("source_id", "target_id", "weight")

    def with_df(self, df: DataFrame, **kwargs: Any) -> EdgeList:
        return replace(self, df=df, **{"factor": None} | kwargs)

    def attach(self, extra_df: DataFrame, id_mapper: IDMapper) -> tuple[EdgeList, IDMapper]:
        """Union with ``source_id, target_id, weight`` edges of other nodes; ids become strings, equal edges sum their weights, codes are new."""
        texts = [F.col(c).cast("string").alias(c) for c in ("source_id", "target_id")]
        both = self.frame(id_mapper).select(*texts, "weight").unionByName(extra_df.select(*texts, F.col("weight").cast("double").alias("weight")))
        return from_frame(both.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight")), directed=self.directed)


#: A graph is its edge list; its nodes are those of the IDMapper beside it.
Graph = EdgeList


def from_frame(frame: DataFrame, directed: bool = False, bipartite: bool = False, nodes: DataFrame | None = None, extra: Iterable[str] = ()) -> tuple[EdgeList, IDMapper]:
    """Edge list and mapper of ``source_id, target_id[, weight]`` in original ids; nodes (node_id) adds isolated ones.

    The input is read once; the mapper and the coded edges are tables in the
    shared folder, so whatever follows reads those.
    """
    weight = ["weight"] if "weight" in frame.columns else []
    frame, own = frame.select("source_id", "target_id", *weight, *extra), hasattr(frame, "checkpoint_path")
    frame = frame if own else checkpointed(frame)
    ends = frame.select(F.col("source_id").alias("node_id")).union(frame.select("target_id"))
    if nodes is not None:
        ends = ends.union(nodes.select("node_id"))
    mapper = IDMapper(checkpointed(dense_codes(checkpointed(ends.distinct()), "node_id")))
    coded = mapper.encode(mapper.encode(frame, "source_id", "src"), "target_id", "tgt")
    edges = EdgeList(checkpointed(coded.select("src", "tgt", *weight, *extra)), directed, bipartite)
    if not own:
        released(frame)
    return edges, mapper


def as_frame(edges: EdgeList | DataFrame, mapper: IDMapper | None = None) -> DataFrame:
    """``source_id, target_id, weight`` of any input that operators take."""
    if isinstance(edges, EdgeList):
        return edges.frame(mapper)
    missing = [c for c in ("source_id", "target_id") if c not in edges.columns]
    if missing:
        raise ValidationError(f"edges lack {missing}", field="edges", expected="source_id, target_id[, weight]")
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("source_id", "target_id", w.alias("weight"))


def endpoints(frame: DataFrame) -> DataFrame:
    """``node_id`` of both ends of all edges, repeated."""
    return frame.select(F.col("source_id").alias("node_id")).union(frame.select("target_id"))
