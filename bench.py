"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from netspark import queries  # noqa: E402
from netspark.session import session  # noqa: E402

HEADLINES = ["edges_weight_sum", "edgelist_codes", "project_count", "project_jaccard", "temporal_projection", "bb_disparity_undirected", "bb_noise_corrected", "bb_svn_weighted", "filter_and", "components", "khop_both", "centrality_degree", "pagerank_fixed", "glp_fixed_k", "glp_converged", "slices_daily", "temporal_stats", "keywords_agg", "cosine_knn_union", "pipeline_canonical"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    with tempfile.TemporaryDirectory(prefix="netspark-bench-") as shared:
        spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{shared}"})
        spark.sparkContext.setLogLevel("ERROR")
        spark.range(10**6).selectExpr("sum(id)").collect()
        took: dict[str, float] = {}
        for name in HEADLINES:
            began = time.perf_counter()
            queries.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
