"""Products with the weights of a count projection, by the rows it is made of.

Two ids' weight is the number of shared ids that both have, so a sum over a
node's neighbours is a sum over its shared ids, of what all members of each
bring without the node itself: rounds of iterations go along the rows, of
which there are far fewer than pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netspark.session import BROADCAST_ROWS, checkpointed

#: The largest factor that is sent to the driver, for a kernel there.
KERNEL_ROWS = 2_000_000


class Factor:
    """Distinct rows ``s, p``: the graph has an edge for each two p with a common s, and as weight the number of these. Every s has two p at least."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n, ids, shared = rows.agg(F.count("*"), F.approx_count_distinct("p"), F.approx_count_distinct("s")).first()
        self.few = {"p": ids < BROADCAST_ROWS, "s": shared < BROADCAST_ROWS}
        self._total: DataFrame | None = None

    def _small(self, df: DataFrame, column: str) -> DataFrame:
        return F.broadcast(df) if self.few[column] else df

    def times(self, x: DataFrame, node: str, columns: list[Column]) -> DataFrame:
        """``to, m0..``: for each node the sums over its neighbours of weight times a column of x."""
        names = [f"c{i}" for i in range(len(columns))]
        own = self._small(x.select(F.col(node).alias("p"), *[c.alias(n) for c, n in zip(columns, names, strict=True)]), "p")
        rows = self.rows.join(own, "p")
        all_ = rows.groupBy("s").agg(*[F.sum(c).alias("g" + c) for c in names])
        # Differences by shared id, so that what only the node itself brings is exactly nothing.
        out = rows.join(self._small(all_, "s"), "s").groupBy(F.col("p").alias("to"))
        return out.agg(*[F.sum(F.col("g" + c) - F.col(c)).alias(f"m{i}") for i, c in enumerate(names)])

    def total(self) -> DataFrame:
        """``node, t``: the sum of each node's weights."""
        if self._total is None:
            nodes = self.rows.select("p").distinct()
            self._total = checkpointed(self.times(nodes, "p", [F.lit(1.0)]).toDF("node", "t"))
        return self._total

    def kernel(self, nodes: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
        """times() for arrays over ascending nodes, if the rows are few enough for the driver."""
        if self.n > KERNEL_ROWS:
            return None
        table = self.rows.select("s", "p").toArrow()
        p = np.searchsorted(nodes, table["p"].to_numpy())
        s = np.unique(table["s"].to_numpy(), return_inverse=True)[1]
        keys = int(s.max()) + 1 if len(s) else 0

        def one(x: np.ndarray) -> np.ndarray:
            own = x[p]
            return np.bincount(p, np.bincount(s, own, keys)[s] - own, len(nodes))

        return lambda x: one(x) if x.ndim == 1 else np.stack([one(c) for c in x.T], axis=1)
