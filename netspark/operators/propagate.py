"""Guided label propagation: seeds' labels spread along row-normalised edges."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper
from netspark.errors import ConfigurationError, ConvergenceError, ValidationError
from netspark.functions.weights import WeightTransform, transformed
from netspark.operators.factor import KERNEL_ROWS, Factor
from netspark.operators.seeds import known_seeds, normalize_seed_input
from netspark.session import checkpointed, measured, released, small

log = logging.getLogger("netspark.propagate")
NOISE = "noise"
#: Up to so many arcs and label cells one numpy kernel on the driver iterates; beyond, Spark joins do.
KERNEL_ARCS, KERNEL_CELLS = 2_000_000, 20_000_000


def transition(graph: EdgeList, direction: str, weight_transform: WeightTransform | None = None) -> DataFrame | Factor:
    """``row, col, p``: row-normalised weights along out-edges (``out_degree``), against in-edges (``in_degree``), or both ways if undirected; the factor of a graph that has one stands for them."""
    if graph.factor is not None and weight_transform is None:
        return Factor(graph.factor)
    e = graph.weighted().select("src", "tgt", transformed(F.col("weight"), weight_transform).alias("w"))
    if not graph.directed:
        e = e.union(e.select("tgt", "src", "w"))
    elif direction == "in_degree":
        e = e.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "w")
    e = checkpointed(e.groupBy(F.col("src").alias("row"), F.col("tgt").alias("col")).agg(F.sum("w").alias("w")))
    total = e.groupBy("row").agg(F.sum("w").alias("t"))
    return e.join(total, "row").where("t > 0").select("row", "col", (F.col("w") / F.col("t")).alias("p"))


def spread(p: DataFrame | Factor, y: DataFrame, alpha: float, iterations: int, prior: DataFrame | None = None, every: int = 5, tol: float | None = None, snapshots: list | None = None) -> tuple[DataFrame, int, float]:
    """``node, f`` after iterations of F = alpha P (F * D) + (1 - alpha) Y from F = Y, arrays of labels; the rounds done and the last largest change.

    A round joins along the arcs, adds arrays element by element in one
    aggregation per label, and joins that to the nodes. With a tolerance each
    round's table is written, which cuts the plan, and the pass that writes it
    measures the change; without one every few rounds are. snapshots takes the
    ``node, f`` tables of all rounds.
    """
    x = checkpointed((y if prior is None else y.join(prior, "node")).withColumn("f", F.col("y")))
    head = x.first()
    k = len(head["y"]) if head else 0
    if not k:
        return x.select("node", "f"), 0, 0.0
    p, first = p if isinstance(p, Factor) else checkpointed(p), x
    weight = (lambda i: F.col("f")[i]) if prior is None else (lambda i: F.col("f")[i] * F.col("d")[i])
    same = [c for c in x.columns if c != "f"]
    done, change, written = 0, float("inf"), x
    while done < iterations:
        if isinstance(p, Factor):
            got = p.times(x, "node", [weight(i) for i in range(k)]).join(p.total(), F.col("to") == F.col("node")).select("to", *[(F.col(f"m{i}") / F.col("t")).alias(f"m{i}") for i in range(k)])
        else:
            got = p.join(x.drop("y"), F.col("col") == F.col("node")).groupBy(F.col("row").alias("to")).agg(*[F.sum(F.col("p") * weight(i)).alias(f"m{i}") for i in range(k)])
        f = F.array(*[alpha * F.coalesce(f"m{i}", F.lit(0.0)) + (1 - alpha) * F.col("y")[i] for i in range(k)])
        new = x.withColumnRenamed("f", "g").join(got, F.col("node") == F.col("to"), "left").withColumn("f", f)
        done += 1
        if tol is not None or snapshots is not None:
            new, seen = measured(new.select(*same, "f", F.array_max(F.zip_with("f", "g", lambda a, b: F.abs(a - b))).alias("moved")), F.max("moved").alias("most"))
            change = seen["most"] or 0.0
        elif done % every == 0 or done == iterations or isinstance(p, Factor):  # a factor's rounds read x twice
            new = checkpointed(new.select(*same, "f"))
        x = new.select(*same, "f")
        if hasattr(new, "checkpoint_path"):
            if written is not first and snapshots is None:
                released(written)
            written = new
        if snapshots is not None:
            snapshots.append(x.select("node", "f"))
        if tol is not None and change < tol:
            break
    if not isinstance(p, Factor):
        released(p)
    return x.select("node", "f"), done, change


def _kernel(p: tuple[np.ndarray, np.ndarray, np.ndarray] | Callable[[np.ndarray], np.ndarray], y: np.ndarray, alpha: float, iterations: int, tol: float, prior: np.ndarray | None, snapshots: list | None = None) -> tuple[np.ndarray, int, float]:
    """The same on one machine: arcs sorted by row, sums by np.add.reduceat; or p as a function that gives all rows' sums."""
    if not callable(p):
        row, col, value = p
        order = np.argsort(row, kind="stable")
        row, col, value = row[order], col[order], value[order, None]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    f, change = y.copy(), float("inf")
    for i in range(1, iterations + 1):
        g = f if prior is None else f * prior
        new = (1 - alpha) * y
        if callable(p):
            new += alpha * p(g)
        elif len(begin):
            new[row[begin]] += alpha * np.add.reduceat(value * g[col], begin, axis=0)
        change = float(np.abs(new - f).max()) if new.size else 0.0
        f = new
        if snapshots is not None:
            snapshots.append(f.copy())
        if change < tol:
            return f, i, change
    return f, iterations, change


def distance_prior(graph: EdgeList, id_mapper: IDMapper, seeds: DataFrame, labels: list[str], exponent: float = 1.0) -> DataFrame:
    """``node, d``: for each label the mean over its seeds of 1 / (steps + 1)^exponent along undirected unweighted edges, 0 where none leads.

    Rounds of a join advance all seeds' frontiers at once, keyed by seed.
    """
    steps = graph.df.select("src", "tgt").union(graph.df.select("tgt", "src")).toDF("a", "b").distinct()
    seen = checkpointed(seeds.select(F.col("node").alias("seed"), "label", "node", F.lit(0).alias("hop")))
    hop = 0
    while True:
        hop += 1
        fresh = seen.where(F.col("hop") == hop - 1).join(steps, F.col("node") == F.col("a")).select("seed", "label", F.col("b").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        then = checkpointed(seen.unionByName(fresh.select("seed", "label", "node", F.lit(hop).alias("hop"))))
        grown = not then.where(F.col("hop") == hop).isEmpty()
        released(seen)
        seen = then
        if not grown:
            break
    sums = seen.groupBy("node").pivot("label", labels).agg(F.sum(1 / F.pow(F.col("hop") + 1.0, F.lit(exponent))))
    counts = {r[0]: r[1] for r in seeds.groupBy("label").count().collect()}
    d = F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)) / max(1, counts.get(x, 0)) for x in labels])
    return id_mapper.nodes.select(F.col("code").alias("node")).join(sums, "node", "left").select("node", d.alias("d"))


def _noise_seeds(id_mapper: IDMapper, seeds: dict, count: int, seed: int) -> list[Any]:
    """A seeded sample of nodes without a label: those of the least hashes of code and seed; only count ids reach the driver."""
    kind = id_mapper.nodes.schema["node_id"].dataType.simpleString()
    taken = id_mapper.nodes.sparkSession.createDataFrame([(x,) for x in seeds], f"node_id {kind}")
    free = id_mapper.nodes.join(small(taken), "node_id", "left_anti")
    return [r[0] for r in free.orderBy(F.xxhash64("code", F.lit(seed)), "code").limit(count).select("node_id").collect()]


def noise_count(n_seeds: int, ratio: float) -> int:
    return max(1, int(ratio * n_seeds))


def with_noise(id_mapper: IDMapper, seeds: dict, labels: list[str], noise_ratio: float, random_seed: int) -> tuple[dict, list[str]]:
    """Seeds and labels with the noise label last; noise seeds are drawn unless some are given."""
    labels = [x for x in labels if x != NOISE] + [NOISE]
    if NOISE not in seeds.values():
        drawn = _noise_seeds(id_mapper, seeds, noise_count(len(seeds), noise_ratio), random_seed)
        seeds = seeds | dict.fromkeys(drawn, NOISE)
    return seeds, labels


def _validated(graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], alpha: float, max_iterations: int, tol: float, noise: bool, noise_ratio: float, confidence: float, node_col: str, label_col: str) -> dict[Any, str]:
    if not labels or len(set(labels)) != len(labels):
        raise ValidationError("labels must be given once each", field="labels", value=labels)
    if not 0 < alpha < 1:
        raise ConfigurationError("alpha must lie between 0 and 1", parameter="alpha", value=alpha)
    if max_iterations < 1 or tol <= 0:
        raise ConfigurationError("max_iterations and convergence_threshold must be positive", parameter="max_iterations", value=max_iterations)
    if not 0 <= confidence <= 1:
        raise ConfigurationError("confidence_threshold must lie in [0, 1]", parameter="confidence_threshold", value=confidence)
    if noise and not 0 < noise_ratio <= 1:
        raise ConfigurationError("noise_ratio must lie in (0, 1]", parameter="noise_ratio", value=noise_ratio)
    seeds = normalize_seed_input(seed_labels, node_col, label_col)
    allowed = set(labels) | ({NOISE} if noise else set())
    if wrong := sorted(set(seeds.values()) - allowed):
        raise ValidationError(f"seeds have unknown labels {wrong}", field="seed_labels", value=wrong, expected=str(labels))
    here = known_seeds(seeds, id_mapper)
    if not here:
        raise ValidationError("no seed is in the graph", field="seed_labels")
    if len(here) < len(seeds):
        log.warning("%d seeds are not in the graph", len(seeds) - len(here))
    return here


def _seed_codes(id_mapper: IDMapper, seeds: dict) -> DataFrame:
    """``node, label`` of seeds in codes."""
    kind = id_mapper.nodes.schema["node_id"].dataType.simpleString()
    rows = id_mapper.nodes.sparkSession.createDataFrame(list(seeds.items()), f"node_id {kind}, label string")
    return id_mapper.nodes.join(small(rows), "node_id").select(F.col("code").alias("node"), "label")


def start_matrix(id_mapper: IDMapper, seeds: dict, labels: list[str]) -> DataFrame:
    """``node, y``: one-hot rows of seeds, zeros elsewhere."""
    hot = _seed_codes(id_mapper, seeds)
    y = F.array(*[F.coalesce((F.col("label") == x).cast("double"), F.lit(0.0)) for x in labels])
    return id_mapper.nodes.select(F.col("code").alias("node")).join(small(hot), "node", "left").select("node", y.alias("y"))


def _converged(iterations: int, change: float, tol: float, most: int) -> None:
    if change < tol:
        return
    error = ConvergenceError(f"propagation did not converge in {most} iterations", algorithm="guided_label_propagation", iterations=iterations, max_iterations=most, final_change=change, threshold=tol)
    if not error.is_partial_result_usable():
        raise error
    log.warning("%s", error)


def propagate_matrix(graph: EdgeList, id_mapper: IDMapper, y: DataFrame, alpha: float, max_iterations: int, tol: float, direction: str, weight_transform: WeightTransform | None = None, prior: DataFrame | None = None, snapshots: list | None = None) -> tuple[DataFrame, int]:
    """``node, f`` at convergence, by the kernel that fits the size."""
    p = transition(graph, direction, weight_transform)
    factored = isinstance(p, Factor)
    arcs = None if factored else p.limit(KERNEL_ARCS + 1).toArrow()
    here = p.n <= min(KERNEL_ARCS, KERNEL_ROWS) if factored else arcs.num_rows <= KERNEL_ARCS
    rows = y.orderBy("node").limit(KERNEL_CELLS + 1).toArrow() if here else None
    k = len(rows["y"][0]) if rows is not None and rows.num_rows else 1
    if rows is None or rows.num_rows * k > KERNEL_CELLS:
        f, done, change = spread(p, y, alpha, max_iterations, prior, tol=tol, snapshots=snapshots)
        _converged(done, change, tol, max_iterations)
        return f, done
    nodes = rows["node"].to_numpy()
    start = np.array(rows["y"].to_pylist(), float).reshape(len(nodes), -1)
    at = lambda c: np.searchsorted(nodes, arcs[c].to_numpy())
    d = None
    if prior is not None:
        d = np.array([r[0] for r in prior.orderBy("node").select("d").collect()], float).reshape(len(nodes), -1)
    rounds: list | None = None if snapshots is None else []
    if factored:
        times = p.kernel(nodes)
        total = times(np.ones(len(nodes)))[:, None]
        product = lambda g: np.divide(times(g), total, out=np.zeros_like(g), where=total > 0)
    f, done, change = _kernel(product if factored else (at("row"), at("col"), arcs["p"].to_numpy()), start, alpha, max_iterations, tol, d, rounds)
    _converged(done, change, tol, max_iterations)

    def table(f: np.ndarray) -> DataFrame:
        values = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]) if f.size else pa.array([], pa.list_(pa.float64()))
        return y.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "f": values.cast(pa.list_(pa.float64()))}))

    if snapshots is not None:
        snapshots += [table(x) for x in rounds]
    return table(f), done


def results(f: DataFrame, id_mapper: IDMapper, labels: list[str], seeds: dict, normalize: bool = True) -> DataFrame:
    """``node_id, {label}_prob…, dominant_label, confidence, is_seed``; zero rows become uniform if normalised; the first of equal labels dominates."""
    k = len(labels)
    if normalize:
        total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
        f = f.select("node", F.when(total > 0, F.transform("f", lambda x: F.try_divide(x, total))).otherwise(F.array(*[F.lit(1.0 / k)] * k)).alias("f"))
    top = F.array_max("f")
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("f", top).cast("int"))
    hot = _seed_codes(id_mapper, seeds).select("node", F.lit(True).alias("s"))
    decoded = id_mapper.nodes.select(F.col("code").alias("node"), "node_id").join(f, "node").join(small(hot), "node", "left")
    return decoded.select("node_id", *[F.col("f")[i].alias(f"{x}_prob") for i, x in enumerate(labels)], named.alias("dominant_label"), top.alias("confidence"), F.coalesce("s", F.lit(False)).alias("is_seed"))


def finished(df: DataFrame, confidence_threshold: float, exclude: Iterable[Any] | DataFrame | None) -> DataFrame:
    """Low confidence becomes ``uncertain``; then excluded nodes go."""
    if confidence_threshold > 0:
        df = df.withColumn("dominant_label", F.when(F.col("confidence") < confidence_threshold, "uncertain").otherwise(F.col("dominant_label")))
    if exclude is not None:
        gone = exclude.select(F.col(exclude.columns[0]).alias("node_id")) if isinstance(exclude, DataFrame) else df.sparkSession.createDataFrame([(x,) for x in exclude], "node_id " + df.schema["node_id"].dataType.simpleString())
        df = df.join(gone, "node_id", "left_anti")
    return df


def guided_label_propagation(graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], alpha: float = 0.85, max_iterations: int = 100, convergence_threshold: float = 1e-6, normalize: bool = True, directional: bool = True, n_jobs: int = 1, enable_noise_category: bool = False, noise_ratio: float = 0.1, confidence_threshold: float = 0.0, seed_node_col: str = "node_id", seed_label_col: str = "label", weight_transform: WeightTransform | None = None, random_seed: int = 42, exclude_from_output: Iterable[Any] | DataFrame | None = None, distance_prior: bool = False, distance_prior_exponent: float = 1.0, verbose: bool = True, return_snapshots: bool = False) -> Any:
    """Label probabilities of every node; for directed graphs with directional an (out, in) pair.

    Seeds aren't clamped. Rounds end when no probability changes by the
    threshold; if they run out, a change of at most ten thresholds is only
    warned of. return_snapshots adds the ``node, f`` tables of all rounds, at any size.
    """
    seeds = _validated(graph, id_mapper, seed_labels, labels, alpha, max_iterations, convergence_threshold, enable_noise_category, noise_ratio, confidence_threshold, seed_node_col, seed_label_col)
    own = dict(seeds)
    if enable_noise_category:
        seeds, labels = with_noise(id_mapper, seeds, labels, noise_ratio, random_seed)
    y = start_matrix(id_mapper, seeds, labels)
    prior = globals()["distance_prior"](graph, id_mapper, _seed_codes(id_mapper, seeds), labels, distance_prior_exponent) if distance_prior else None
    snapshots: list = []
    out = []
    for direction in ("out_degree", "in_degree") if graph.directed and directional else ("out_degree",):
        f, _ = propagate_matrix(graph, id_mapper, y, alpha, max_iterations, convergence_threshold, direction, weight_transform, prior, snapshots if return_snapshots else None)
        out.append(finished(results(f, id_mapper, labels, seeds if not enable_noise_category else seeds | own, normalize), confidence_threshold, exclude_from_output))
    result = tuple(out) if len(out) > 1 else out[0]
    return (result, snapshots) if return_snapshots else result


def ensemble_label_propagation(graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], n_epochs: int = 10, base_seed: int = 42, return_variance: bool = False, n_workers: int | None = None, verbose: bool = True, **glp_kwargs: Any) -> Any:
    """Means over epochs that draw their noise seeds anew, and with return_variance ``{label}_std``.

    The update is linear in each label's column by itself, so one propagation
    carries the columns of the labels and one noise column per epoch; each
    epoch is then normalised on its own. Without the noise category there is
    nothing to vary: one run, and a warning. Rounds end when all columns have
    converged.
    """
    if n_epochs < 2:
        raise ConfigurationError("an ensemble has at least 2 epochs", parameter="n_epochs", value=n_epochs)
    if not glp_kwargs.get("enable_noise_category", False):
        log.warning("without the noise category all epochs are the same")
        return guided_label_propagation(graph, id_mapper, seed_labels, labels, **glp_kwargs)
    g = {"alpha": 0.85, "max_iterations": 100, "convergence_threshold": 1e-6, "normalize": True, "directional": True, "noise_ratio": 0.1, "confidence_threshold": 0.0, "seed_node_col": "node_id", "seed_label_col": "label", "weight_transform": None, "exclude_from_output": None, "distance_prior": False, "distance_prior_exponent": 1.0} | glp_kwargs
    seeds = _validated(graph, id_mapper, seed_labels, labels, g["alpha"], g["max_iterations"], g["convergence_threshold"], True, g["noise_ratio"], g["confidence_threshold"], g["seed_node_col"], g["seed_label_col"])
    own = [x for x in labels if x != NOISE]
    k = len(own)
    real = {n: x for n, x in seeds.items() if x != NOISE}
    fixed = [n for n, x in seeds.items() if x == NOISE]
    count = noise_count(len(seeds), g["noise_ratio"])
    epochs = [fixed or _noise_seeds(id_mapper, real, count, base_seed + e) for e in range(n_epochs)]
    kind = id_mapper.nodes.schema["node_id"].dataType.simpleString()
    spark = id_mapper.nodes.sparkSession
    hot = spark.createDataFrame([(n, own.index(x)) for n, x in real.items()] + [(n, k + e) for e, ns in enumerate(epochs) for n in ns], f"node_id {kind}, c int")
    hot = hot.groupBy("node_id").agg(F.collect_set("c").alias("cs"))
    y = id_mapper.nodes.join(small(hot), "node_id", "left").select(F.col("code").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(k + n_epochs - 1)), lambda i: F.coalesce(F.array_contains("cs", i).cast("double"), F.lit(0.0))).alias("y"))
    prior = None
    if g["distance_prior"]:
        marks = spark.createDataFrame([(n, x) for n, x in real.items()] + [(n, f"{NOISE}{e}") for e, ns in enumerate(epochs) for n in ns], f"node_id {kind}, label string")
        codes = id_mapper.nodes.join(small(marks), "node_id").select(F.col("code").alias("node"), "label")
        prior = distance_prior(graph, id_mapper, codes, own + [f"{NOISE}{e}" for e in range(n_epochs)], g["distance_prior_exponent"])
    names = [*own, NOISE]
    out = []
    for direction in ("out_degree", "in_degree") if graph.directed and g["directional"] else ("out_degree",):
        f, _ = propagate_matrix(graph, id_mapper, y, g["alpha"], g["max_iterations"], g["convergence_threshold"], direction, g["weight_transform"], prior)
        epoch = F.posexplode(F.transform(F.slice("f", k + 1, n_epochs), lambda z: F.concat(F.slice("f", 1, k), F.array(z))))
        one = f.select("node", epoch.alias("e", "f"))
        if g["normalize"]:
            total = F.aggregate("f", F.lit(0.0), lambda a, x: a + x)
            one = one.select("node", F.when(total > 0, F.transform("f", lambda x: F.try_divide(x, total))).otherwise(F.array(*[F.lit(1.0 / (k + 1))] * (k + 1))).alias("f"))
        mean = one.groupBy("node").agg(F.array(*[F.avg(F.col("f")[i]) for i in range(k + 1)]).alias("f"), *[F.stddev_samp(F.col("f")[i]).alias(f"{x}_std") for i, x in enumerate(names)])
        df = results(mean.select("node", "f"), id_mapper, names, real, normalize=False)
        if return_variance:
            std = id_mapper.nodes.select("node_id", F.col("code").alias("node")).join(mean.drop("f"), "node").drop("node")
            df = df.join(std, "node_id")
        out.append(finished(df, g["confidence_threshold"], g["exclude_from_output"]))
    return tuple(out) if len(out) > 1 else out[0]


def audience_pass(edges: DataFrame, forward: DataFrame, columns: list[str], normalize: bool = True) -> DataFrame:
    """``node_id`` and columns: weighted means over the sources of each target's edges (source_id, target_id, weight); targets absent from edges aren't listed."""
    x = edges.join(forward.select(F.col("node_id").alias("source_id"), *columns), "source_id", "left")
    return x.groupBy(F.col("target_id").alias("node_id")).agg(*[F.coalesce(F.try_divide(F.sum(F.col("weight") * F.coalesce(c, F.lit(0.0))), F.sum("weight")), F.lit(0.0)).alias(c) for c in columns])


def audience_composition_pass(graph: EdgeList, id_mapper: IDMapper, forward_result: DataFrame, labels: list[str], weight_transform: WeightTransform | None = None, normalize: bool = True) -> DataFrame:
    """Who points to each node: the weighted mean of its in-neighbours' probabilities; uniform for nodes without any, if normalised."""
    if not graph.directed:
        raise ValidationError("an audience needs a directed graph", field="graph")
    columns = [f"{x}_prob" for x in labels]
    missing = [c for c in ["node_id", *columns] if c not in forward_result.columns]
    if missing:
        raise ValidationError(f"forward_result lacks {missing}", field="forward_result", value=forward_result.columns)
    e = graph.frame(id_mapper)
    e = e.withColumn("weight", transformed(F.col("weight"), weight_transform))
    means = audience_pass(e, forward_result, columns)
    own = id_mapper.nodes.join(means, "node_id", "left").select(F.col("code").alias("node"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]).alias("f"))
    seeds = [r[0] for r in forward_result.where("is_seed").select("node_id").collect()] if "is_seed" in forward_result.columns else []
    return results(own, id_mapper, labels, dict.fromkeys(seeds, labels[0]) or {}, normalize) if seeds else results(own, id_mapper, labels, {}, normalize)


def get_propagation_info(graph: EdgeList, seed_labels: Any, labels: list[str], seed_node_col: str = "node_id", seed_label_col: str = "label") -> dict[str, Any]:
    """Sizes, estimates and possible problems before a run."""
    seeds = normalize_seed_input(seed_labels, seed_node_col, seed_label_col)
    counts = {x: sum(v == x for v in seeds.values()) for x in labels}
    n, m = graph.number_of_nodes(), graph.number_of_edges()
    issues = [f"label {x!r} has no seeds" for x, c in counts.items() if not c]
    if counts and min(counts.values()) and max(counts.values()) > 10 * min(counts.values()):
        issues.append("seeds are imbalanced")
    if n and len(seeds) / n < 0.001:
        issues.append("there are few seeds for so many nodes")
    return {"n_nodes": n, "n_edges": m, "n_labels": len(labels), "n_seeds": len(seeds), "seeds_per_label": counts, "seed_ratio": len(seeds) / n if n else 0.0, "directed": graph.directed, "estimated_memory_mb": (n * len(labels) * 16 + m * 24) / 2**20, "potential_issues": issues}
