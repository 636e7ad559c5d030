"""What a propagation found: distributions of labels, and how both directions differ."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.errors import ValidationError


def _require(df: DataFrame, columns: list[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValidationError(f"{name} lacks {missing}", field=name, value=df.columns)


def label_distribution(predictions: DataFrame) -> DataFrame:
    """``dominant_label, n, mean_confidence``."""
    return predictions.groupBy("dominant_label").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def label_entropy(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """One row: ``label_entropy``, the mean of -sum p ln p with p from 1e-10 to 1."""
    total = F.lit(0.0)
    for x in labels:
        p = F.least(F.greatest(F.col(f"{x}_prob"), F.lit(1e-10)), F.lit(1.0))
        total = total - p * F.ln(p)
    return predictions.agg(F.avg(total).alias("label_entropy"))


def probability_histogram(predictions: DataFrame, labels: list[str], bins: int = 20) -> DataFrame:
    """``label, bin, n``: equal bins on [0, 1], the last closed."""
    long = predictions.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"{x}_prob").alias("p")) for x in labels])).alias("e")).select("e.*")
    return long.where("p BETWEEN 0 AND 1").groupBy("label", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def analyze_label_distribution(predictions: DataFrame, labels: list[str]) -> dict[str, Any]:
    _require(predictions, ["node_id", "dominant_label", "confidence", "is_seed", *[f"{x}_prob" for x in labels]], "predictions")
    rows = label_distribution(predictions).collect()
    n = sum(r["n"] for r in rows)
    hist = {x: np.zeros(20, int) for x in labels}
    for r in probability_histogram(predictions, labels).collect():
        hist[r["label"]][r["bin"]] = r["n"]
    by = {r[0]: r[1] for r in predictions.groupBy("is_seed").agg(F.avg("confidence")).collect()}
    seed, other = by.get(True, 0.0), by.get(False, 0.0)
    confidence = {r["dominant_label"]: r["mean_confidence"] for r in rows}
    return {"total_nodes": n, "total_labeled_nodes": sum(r["n"] for r in rows if r["dominant_label"] in labels), "label_counts": {r["dominant_label"]: r["n"] for r in rows}, "mean_confidence": sum(r["n"] * r["mean_confidence"] for r in rows) / n if n else 0.0, "confidence_by_label": {x: confidence.get(x, 0.0) for x in labels}, "probability_distributions": hist, "high_confidence_nodes": predictions.where("confidence > 0.8"), "uncertain_nodes": predictions.where("confidence < 0.5"), "seed_vs_nonseed_confidence": {"seed_confidence": seed, "nonseed_confidence": other, "confidence_difference": seed - other}, "label_entropy": label_entropy(predictions, labels).first()[0] or 0.0}


def merged_directions(out_df: DataFrame, in_df: DataFrame, labels: list[str]) -> DataFrame:
    """Both results by node: columns with the suffixes _out and _in."""
    columns = ["dominant_label", "confidence", *[f"{x}_prob" for x in labels]]
    side = lambda df, s: df.select("node_id", *[F.col(c).alias(c + s) for c in columns])
    return side(out_df, "_out").join(side(in_df, "_in"), "node_id")


def directional_agreement(merged: DataFrame, labels: list[str]) -> DataFrame:
    """One row: ``agreement_rate, out_degree_confidence, in_degree_confidence``, and for each label ``{label}_correlation`` (0 where undefined), ``{label}_out, {label}_in`` means."""
    agree = F.avg((F.col("dominant_label_out") == F.col("dominant_label_in")).cast("double"))
    out = [agree.alias("agreement_rate"), F.avg("confidence_out").alias("out_degree_confidence"), F.avg("confidence_in").alias("in_degree_confidence")]
    for x in labels:
        r = F.corr(f"{x}_prob_out", f"{x}_prob_in")
        out += [F.when(F.isnan(r) | r.isNull(), 0.0).otherwise(r).alias(f"{x}_correlation"), F.avg(f"{x}_prob_out").alias(f"{x}_out"), F.avg(f"{x}_prob_in").alias(f"{x}_in")]
    return merged.agg(*out)


def compare_directional_results(out_degree_predictions: DataFrame, in_degree_predictions: DataFrame, labels: list[str]) -> dict[str, Any]:
    for df, name in ((out_degree_predictions, "out_degree_predictions"), (in_degree_predictions, "in_degree_predictions")):
        _require(df, ["node_id", "dominant_label", "confidence", *[f"{x}_prob" for x in labels]], name)
    merged = merged_directions(out_degree_predictions, in_degree_predictions, labels)
    r = directional_agreement(merged, labels).first()
    if r["agreement_rate"] is None:
        raise ValidationError("both results have no node in common", field="predictions")
    differences = [(F.col(f"{x}_prob_out") - F.col(f"{x}_prob_in")).alias(f"{x}_diff") for x in labels]
    largest = F.greatest(*[F.abs(d) for d in differences]) if len(labels) > 1 else F.abs(differences[0])
    table = merged.select("node_id", "dominant_label_out", "dominant_label_in", *differences, largest.alias("max_abs_diff"))
    bias = {x: "out" if r[f"{x}_out"] > r[f"{x}_in"] else "in" if r[f"{x}_out"] < r[f"{x}_in"] else "equal" for x in labels}
    out, in_ = r["out_degree_confidence"], r["in_degree_confidence"]
    return {"agreement_rate": r["agreement_rate"], "correlation_by_label": {x: r[f"{x}_correlation"] for x in labels}, "divergent_nodes": table.where("dominant_label_out <> dominant_label_in"), "direction_bias": bias, "confidence_comparison": {"out_degree_confidence": out, "in_degree_confidence": in_, "confidence_difference": out - in_}, "probability_differences": table.select("node_id", *[f"{x}_diff" for x in labels], "max_abs_diff")}
