"""Networks over calendar slices, and how nodes' metrics develop."""

from __future__ import annotations

import calendar
import logging
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper, dense_codes
from netspark.errors import ValidationError, validate_parameter
from netspark.operators.centrality import METRICS, centrality
from netspark.sources.load import load_edges

log = logging.getLogger("netspark.temporal")
INTERVALS = ["daily", "weekly", "monthly", "yearly"]
STATISTICS = ["mean", "std", "min", "max", "range", "trend", "volatility", "growth_rate"]


def _day_end(t: datetime) -> datetime:
    return t.replace(hour=23, minute=59, second=59, microsecond=999999)


def _day_start(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def slice_ends(start: datetime, end: datetime, interval: str) -> list[datetime]:
    """Ends of slices at 23:59:59.999999: each day from start while its time of day is in range, Sundays up to the end's day, month ends and year ends."""
    out: list[datetime] = []
    if interval == "daily":
        t = start
        while t <= end:
            out.append(_day_end(t))
            t += timedelta(days=1)
    elif interval == "weekly":
        t = start - timedelta(days=start.weekday())
        while t + timedelta(days=6) <= end:
            out.append(_day_end(t + timedelta(days=6)))
            t += timedelta(days=7)
    elif interval == "monthly":
        t = start.replace(day=1)
        while t <= end:
            out.append(_day_end(t.replace(day=calendar.monthrange(t.year, t.month)[1])))
            t = t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1)
    else:
        t = start.replace(month=1, day=1)
        while t <= end:
            out.append(_day_end(t.replace(month=12, day=31)))
            t = t.replace(year=t.year + 1)
    return out


def slice_start(end: datetime, interval: str, periods: int = 1) -> datetime:
    """Start of the last so many periods that end at a slice's end."""
    if interval == "daily":
        return _day_start(end - timedelta(days=periods - 1))
    if interval == "weekly":
        return _day_start(end - timedelta(days=7 * periods - 1))
    if interval == "monthly":
        months = end.year * 12 + end.month - periods
        return datetime(months // 12, months % 12 + 1, 1)
    return datetime(end.year - periods + 1, 1, 1)


def slice_table(spark: SparkSession, start: datetime, end: datetime, interval: str, rolling_window: int | None = None, cumulative: bool = False) -> DataFrame:
    """``slice_start, slice_end``: the calendar as a small table."""
    rows = [(datetime(1, 1, 1) if cumulative else slice_start(e, interval, rolling_window or 1), e) for e in slice_ends(start, end, interval)]
    return spark.createDataFrame(rows, "slice_start timestamp, slice_end timestamp")


def assign_slices(df: DataFrame, timestamp_col: str, slices: DataFrame) -> DataFrame:
    """df with ``slice_end``, a row for each slice that holds it: a range join against the broadcast calendar."""
    t = F.col(timestamp_col)
    return df.join(F.broadcast(slices), (t >= F.col("slice_start")) & (t <= F.col("slice_end"))).drop("slice_start")


@dataclass
class TemporalGraphs:
    """All slices' edges in one table ``slice_end, source_id, target_id, weight``; iterating gives (date, graph, mapper) a slice."""

    edges: DataFrame
    dates: list[datetime]
    directed: bool = False
    mapper: IDMapper | None = field(default=None)

    def __len__(self) -> int:
        return len(self.dates)

    def __getitem__(self, i: int) -> tuple[datetime, EdgeList, IDMapper]:
        date = self.dates[i]
        own = self.edges.where(F.col("slice_end") == F.lit(date))
        mapper = self.mapper or IDMapper(dense_codes(own.select(F.explode(F.array("source_id", "target_id")).alias("n")), "n"))
        coded = mapper.encode(mapper.encode(own, "source_id", "src"), "target_id", "tgt").select("src", "tgt", "weight")
        return date, EdgeList(coded, self.directed), mapper

    def __iter__(self) -> Iterator[tuple[datetime, EdgeList, IDMapper]]:
        return (self[i] for i in range(len(self)))


def create_temporal_slices(edgelist: str | Path | DataFrame, timestamp_col: str = "timestamp", slice_interval: str = "daily", rolling_window: int | None = None, cumulative: bool = False, start_date: datetime | str | None = None, end_date: datetime | str | None = None, source_col: str = "source", target_col: str = "target", weight_col: str | None = None, directed: bool = False, auto_weight: bool = True, allow_self_loops: bool = True, remove_duplicates: bool = False) -> TemporalGraphs:
    """Standard, rolling or cumulative slices; a slice without edges is an empty graph.

    All slices are one range join and one aggregation by slice and pair, never
    a loop over slices.
    """
    validate_parameter(slice_interval, INTERVALS, "slice_interval")
    if rolling_window is not None and (rolling_window < 1 or cumulative):
        raise ValidationError("rolling_window must be positive and not cumulative", field="rolling_window", value=rolling_window)
    df = load_edges(edgelist)
    missing = [c for c in (timestamp_col, source_col, target_col, weight_col) if c and c not in df.columns]
    if missing:
        raise ValidationError(f"columns are missing: {missing}", field="edgelist", value=df.columns)
    if dict(df.dtypes)[timestamp_col] == "string":
        df = df.withColumn(timestamp_col, F.to_timestamp(timestamp_col))
    df = df.dropna(subset=[timestamp_col, source_col, target_col])
    parse = lambda d: datetime.fromisoformat(d) if isinstance(d, str) else d
    lo, hi = parse(start_date), parse(end_date)
    if lo and hi and lo > hi:
        raise ValidationError("start_date lies after end_date", field="start_date", value=str(lo))
    if lo:
        df = df.where(F.col(timestamp_col) >= F.lit(lo))
    if hi:
        df = df.where(F.col(timestamp_col) <= F.lit(hi))
    first, last = df.agg(F.min(F.col(timestamp_col).cast("timestamp")), F.max(F.col(timestamp_col).cast("timestamp"))).first()
    if first is None:
        raise ValidationError("there are no edges in the range of dates", field="timestamp")
    slices = slice_table(df.sparkSession, lo or first, hi or last, slice_interval, rolling_window, cumulative)
    edges = sliced_edges(assign_slices(df, timestamp_col, slices), source_col, target_col, weight_col, auto_weight, allow_self_loops, remove_duplicates)
    return TemporalGraphs(edges, [r[0] for r in slices.select("slice_end").orderBy("slice_end").collect()], directed)


def sliced_edges(df: DataFrame, source_col: str, target_col: str, weight_col: str | None = None, auto_weight: bool = True, allow_self_loops: bool = True, remove_duplicates: bool = False) -> DataFrame:
    """``slice_end, source_id, target_id, weight`` with duplicates treated slice by slice as in construct.process_edges()."""
    if not allow_self_loops:
        df = df.where(F.col(source_col) != F.col(target_col))
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    x = df.select("slice_end", F.col(source_col).alias("source_id"), F.col(target_col).alias("target_id"), w.alias("weight"))
    by = ["slice_end", "source_id", "target_id"]
    if remove_duplicates:
        return x.groupBy(*by).agg(F.min("weight").alias("weight"))
    return x.groupBy(*by).agg(F.sum("weight").alias("weight")) if weight_col or auto_weight else x


def align_node_ids_across_slices(temporal_graphs: TemporalGraphs) -> tuple[TemporalGraphs, IDMapper]:
    """The same slices over one mapper of all their nodes."""
    ends = temporal_graphs.edges.select(F.explode(F.array("source_id", "target_id")).alias("n"))
    mapper = IDMapper(dense_codes(ends, "n"))
    return TemporalGraphs(temporal_graphs.edges, temporal_graphs.dates, temporal_graphs.directed, mapper), mapper


def degree_grid(edges: DataFrame, dates: DataFrame, name: str = "degree") -> DataFrame:
    """``node_id, date, degree`` for every node and slice (slice_end), 0 where absent, unnormalised: one aggregation for all slices."""
    ends = edges.select(F.col("slice_end").alias("date"), F.explode(F.array("source_id", "target_id")).alias("node_id"))
    counts = ends.groupBy("node_id", "date").agg(F.count("*").cast("double").alias(name))
    grid = ends.select("node_id").distinct().crossJoin(F.broadcast(dates.select(F.col("slice_end").alias("date")).distinct()))
    return grid.join(counts, ["node_id", "date"], "left").fillna(0.0, [name])


def extract_temporal_metrics(temporal_graphs: TemporalGraphs, metrics: list[str] | None = None, n_jobs: int = -1) -> DataFrame:
    """``node_id, date`` and a column per metric over the dense grid of nodes and dates.

    Degrees of all slices, normalised by each slice's nodes, are one
    aggregation; other metrics run slice by slice.
    """
    metrics = ["degree", "betweenness"] if metrics is None else metrics
    bad = [m for m in metrics if m not in METRICS]
    if bad or not metrics:
        raise ValidationError(f"unknown metrics {bad}", field="metrics", value=bad, expected=str(METRICS))
    if not len(temporal_graphs):
        raise ValidationError("there are no slices", field="temporal_graphs")
    edges = temporal_graphs.edges
    spark = edges.sparkSession
    dates = spark.createDataFrame([(d,) for d in temporal_graphs.dates], "slice_end timestamp")
    ends = edges.select(F.col("slice_end").alias("date"), F.explode(F.array("source_id", "target_id")).alias("node_id"))
    out = ends.select("node_id").distinct().crossJoin(F.broadcast(dates.select(F.col("slice_end").alias("date"))))
    for m in dict.fromkeys(metrics):
        if m in ("degree", "in_degree", "out_degree"):
            column = {"in_degree": F.array("target_id"), "out_degree": F.array("source_id")}.get(m if temporal_graphs.directed else "degree", F.array("source_id", "target_id"))
            counts = edges.select(F.col("slice_end").alias("date"), F.explode(column).alias("node_id")).groupBy("node_id", "date").agg(F.count("*").cast("double").alias("c"))
            n = ends.groupBy("date").agg(F.count_distinct("node_id").alias("n"))
            scale = (F.col("n") - 1) * (2 if temporal_graphs.directed and m == "degree" else 1)
            values = counts.join(F.broadcast(n), "date").select("node_id", "date", F.coalesce(F.try_divide("c", scale), F.lit(0.0)).alias(m))
        else:
            values = None
            for d in temporal_graphs.dates:
                own = edges.where(F.col("slice_end") == F.lit(d))
                if own.isEmpty():
                    continue
                x = centrality(own.select("source_id", "target_id", "weight"), m, None, temporal_graphs.directed).select("node_id", F.lit(d).alias("date"), F.col("value").alias(m))
                values = x if values is None else values.unionByName(x)
        if values is None:
            out = out.withColumn(m, F.lit(0.0))
        else:
            out = out.join(values, ["node_id", "date"], "left").fillna(0.0, [m])
    return out.orderBy("node_id", "date")


def calculate_temporal_statistics(temporal_metrics: DataFrame, statistics: list[str] | None = None) -> DataFrame:
    """``node_id`` and ``{metric}_{statistic}`` columns.

    std is the sample's, 0 for one point; volatility is std over mean;
    growth_rate is in percent from first to last date; trend is the slope over
    the position in time.
    """
    statistics = ["mean", "std", "trend"] if statistics is None else statistics
    if bad := [s for s in statistics if s not in STATISTICS]:
        raise ValidationError(f"unknown statistics {bad}", field="statistics", value=bad, expected=str(STATISTICS))
    if missing := [c for c in ("node_id", "date") if c not in temporal_metrics.columns]:
        raise ValidationError(f"columns are missing: {missing}", field="temporal_metrics", value=temporal_metrics.columns)
    metrics = [c for c in temporal_metrics.columns if c not in ("node_id", "date")]
    if not metrics:
        raise ValidationError("there are no metrics", field="temporal_metrics")
    at = F.row_number().over(Window.partitionBy("node_id").orderBy("date")) - 1
    df = temporal_metrics.withColumn("__at", at) if "trend" in statistics else temporal_metrics
    return df.groupBy("node_id").agg(*[_statistic(m, s).alias(f"{m}_{s}") for m in metrics for s in statistics]).orderBy("node_id")


def _statistic(m: str, s: str) -> Column:
    c = F.col(m)
    if s in ("mean", "min", "max"):
        return {"mean": F.avg, "min": F.min, "max": F.max}[s](c)
    if s == "std":
        return F.coalesce(F.stddev_samp(c), F.lit(0.0))
    if s == "range":
        return F.max(c) - F.min(c)
    if s == "volatility":
        return F.when(F.avg(c) == 0, F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(c), F.avg(c)))
    if s == "growth_rate":
        first, last = F.min_by(c, F.col("date")), F.max_by(c, F.col("date"))
        return F.when(first != 0, F.try_divide(last - first, first) * 100).when(last == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.coalesce(F.regr_slope(c, F.col("__at")), F.lit(0.0))

