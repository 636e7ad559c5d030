"""Transforms of edge weights, as functions from column to column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netspark.errors import ConfigurationError

WeightTransform = Callable[[Column], Column] | Callable[[float], float]


def tanh_transform(scale: float = 100.0, offset: float = 1.0) -> Callable[[Column], Column]:
    """tanh((w + offset) / scale)"""
    return lambda w: F.tanh((w + F.lit(offset)) / F.lit(scale))


def log1p_transform() -> Callable[[Column], Column]:
    return F.log1p


def winsorize_transform(cap: float) -> Callable[[Column], Column]:
    """Weights above cap become cap."""
    if cap <= 0:
        raise ConfigurationError("cap must be positive", parameter="cap", value=cap)
    return lambda w: F.least(w, F.lit(float(cap)))


def transformed(weight: Column, transform: WeightTransform | None) -> Column:
    """weight after a transform; one that takes floats, not columns, runs as a pandas UDF."""
    if transform is None:
        return weight
    try:
        out = transform(weight)
    except (TypeError, ValueError):  # what columns raise in a comparison or a float() of them
        out = None
    if isinstance(out, Column):
        return out
    return F.pandas_udf(lambda s: s.map(transform).astype("float64"), "double")(weight)


def dimension_weight(weight: Column, transform: str, shift: float, power: float) -> Column:
    """shift, abs, raw or power_shift of a feature's weight."""
    return {"shift": weight + shift, "abs": F.abs(weight), "raw": weight, "power_shift": F.signum(weight) * F.pow(F.abs(weight), F.lit(power)) + shift}[transform]


__all__ = ["WeightTransform", "dimension_weight", "log1p_transform", "tanh_transform", "transformed", "winsorize_transform"]
