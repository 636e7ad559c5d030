"""Grid search over the parameters of propagation."""

from __future__ import annotations

import itertools
import logging
from collections.abc import Sequence
from functools import partial
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper
from netspark.errors import ConfigurationError, NetworkAnalysisError, ValidationError, validate_parameter
from netspark.operators.propagate import ensemble_label_propagation, guided_label_propagation
from netspark.operators.seeds import normalize_seed_input
from netspark.operators.validate import train_test_split_validation

log = logging.getLogger("netspark.grid")
AXES = ("test_size", "alpha", "n_epochs", "distance_prior", "distance_prior_exponent", "noise_ratio")
SCORES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "train_size", "n_test", "total_errors", "noise_errors", "hard_errors", "noise_error_share")
SCHEMA = "test_size double, alpha double, n_epochs int, distance_prior boolean, distance_prior_exponent double, noise_ratio double, repeat int, " + ", ".join(f"{s} double" for s in SCORES) + ", error string"


class GLPGridSearch:
    """Every combination of the axes, each repeat with its own split; a cell that fails is recorded with its error."""

    def __init__(self, graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], *, n_epochs_grid: Sequence[int] | None = None, alpha_grid: Sequence[float] | None = None, test_size_grid: Sequence[float] | None = None, test_seeds: Any = None, distance_prior_grid: Sequence[bool] | None = None, distance_prior_exponent_grid: Sequence[float] | None = None, noise_ratio_grid: Sequence[float] | None = None, n_repeats: int = 1, random_seed: int = 42, stratify: bool = True, directional: bool = False, directional_pass: str | None = None, enable_noise_category: bool = True, noise_ratio: float = 0.1, n_workers: int | None = None, seed_node_col: str = "node_id", seed_label_col: str = "label", **glp_kwargs: Any):
        if test_seeds is not None and test_size_grid is not None:
            raise ConfigurationError("give test_seeds or test_size_grid", parameter="test_size_grid", value=test_size_grid)
        if n_repeats < 1:
            raise ConfigurationError("n_repeats must be positive", parameter="n_repeats", value=n_repeats)
        clash = [k for k in glp_kwargs if k in ("alpha", "distance_prior", "distance_prior_exponent", "noise_ratio", "random_seed")]
        if clash:
            raise ConfigurationError(f"{clash} are axes of the grid", parameter=clash[0])
        self.graph, self.id_mapper, self.labels = graph, id_mapper, labels
        self.seeds = normalize_seed_input(seed_labels, seed_node_col, seed_label_col)
        self.test_seeds = None if test_seeds is None else normalize_seed_input(test_seeds, seed_node_col, seed_label_col)
        self.grid = {"test_size": list(test_size_grid or [0.2]) if test_seeds is None else [0.0], "alpha": list(alpha_grid or [0.85]), "n_epochs": list(n_epochs_grid or [1]), "distance_prior": list(distance_prior_grid or [False]), "distance_prior_exponent": list(distance_prior_exponent_grid or [1.0]), "noise_ratio": list(noise_ratio_grid or [noise_ratio])}
        if any(n > 1 for n in self.grid["n_epochs"]) and not enable_noise_category:
            raise ConfigurationError("epochs differ only with the noise category", parameter="enable_noise_category", value=False)
        self.n_repeats, self.random_seed, self.stratify = n_repeats, random_seed, stratify
        self.directional, self.directional_pass, self.noise = directional, directional_pass, enable_noise_category
        self.glp_kwargs = glp_kwargs
        self._rows: list[tuple] | None = None

    def _cell(self, test_size: float, alpha: float, n_epochs: int, distance_prior: bool, exponent: float, noise_ratio: float, repeat: int) -> dict[str, Any]:
        seed = self.random_seed + repeat
        kwargs = {"alpha": alpha, "distance_prior": distance_prior, "distance_prior_exponent": exponent, "noise_ratio": noise_ratio, "enable_noise_category": self.noise, "directional": self.directional, **self.glp_kwargs}
        propagator = partial(ensemble_label_propagation, n_epochs=n_epochs, base_seed=seed) if n_epochs > 1 else partial(guided_label_propagation, random_seed=seed)
        return train_test_split_validation(self.graph, self.id_mapper, self.seeds, self.labels, test_size=test_size or 0.2, stratify=self.stratify, random_seed=seed, test_seeds=self.test_seeds, propagator=propagator, directional_pass=self.directional_pass, **kwargs)

    def run(self) -> DataFrame:
        rows = []
        for cell in itertools.product(*[self.grid[a] for a in AXES]):
            for repeat in range(self.n_repeats):
                try:
                    r = self._cell(*cell, repeat)
                    r["n_test"] = r["test_size"]
                    rows.append((*cell, repeat, *[float(r[s]) for s in SCORES], None))
                except NetworkAnalysisError as error:
                    log.warning("cell %s failed: %s", cell, error)
                    rows.append((*cell, repeat, *[None] * len(SCORES), str(error)))
        self._rows = rows
        return self.results

    @property
    def results(self) -> DataFrame:
        if self._rows is None:
            raise ValidationError("run() comes first", field="results")
        return self.graph.df.sparkSession.createDataFrame(self._rows, SCHEMA)

    def summary(self, sort_by: str = "macro_f1", descending: bool = True) -> DataFrame:
        """Cells in order of a score; with repeats their means and deviations."""
        df = self.results
        if self.n_repeats > 1:
            df = df.groupBy(*AXES).agg(*[F.avg(s).alias(f"{s}_mean") for s in SCORES], *[F.stddev_samp(s).alias(f"{s}_std") for s in SCORES], F.count("error").alias("n_failed"))
            sort_by = sort_by if sort_by in df.columns else f"{sort_by}_mean"
        if sort_by not in df.columns:
            raise ValidationError(f"column {sort_by} is missing", field="sort_by", value=df.columns)
        return df.orderBy(F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last(), *AXES)

    def best(self, metric: str = "macro_f1", maximize: bool = True) -> dict[str, Any]:
        df = self.results.where("error IS NULL")
        if metric not in df.columns:
            raise ValidationError(f"column {metric} is missing", field="metric", value=df.columns)
        top = df.orderBy(F.desc(metric) if maximize else F.asc(metric), *AXES, "repeat").limit(1).collect()
        if not top:
            raise ValidationError("all cells failed", field="results")
        return top[0].asDict()

    def failed_cells(self) -> DataFrame:
        return self.results.where("error IS NOT NULL")

    def pivot(self, metric: str = "macro_f1", index: str = "alpha", columns: str = "n_epochs", test_size: float | None = None, agg: str = "mean") -> DataFrame:
        """A score over two axes; the others are held at their least value (test_size at the given one)."""
        for axis in (index, columns):
            validate_parameter(axis, list(AXES), "axis")
        if index == columns:
            raise ConfigurationError("index and columns must differ", parameter="columns", value=columns)
        df = self.results.where("error IS NULL")
        for axis in AXES:
            if axis not in (index, columns):
                df = df.where(F.col(axis) == F.lit(test_size if axis == "test_size" and test_size is not None else min(self.grid[axis])))
        how = {"mean": F.avg, "max": F.max, "min": F.min, "first": F.first}[agg]
        return df.groupBy(index).pivot(columns).agg(how(metric)).orderBy(index)


def get_grid_search_summary(grid: GLPGridSearch) -> str:
    n, failed = grid.results.agg(F.count("*"), F.count("error")).first()
    lines = [f"{n} cells, {failed} failed"]
    if failed < n:
        b = grid.best()
        lines += [f"best macro f1 {b['macro_f1']:.3f}, accuracy {b['accuracy']:.3f}", "with " + ", ".join(f"{a} {b[a]}" for a in AXES)]
    return "\n".join(lines)
