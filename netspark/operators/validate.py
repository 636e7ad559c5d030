"""Scores of predictions against held-out and independent labels."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.edges import EdgeList, IDMapper
from netspark.errors import ComputationError, ConfigurationError, ValidationError
from netspark.operators.propagate import NOISE, guided_label_propagation
from netspark.operators.seeds import known_seeds, normalize_seed_input
from netspark.session import small


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """``true_label, predicted_label, n``."""
    return df.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))


def label_scores(counts: DataFrame, labels: list[str]) -> DataFrame:
    """``label, precision, recall, f1_score, support`` of confusion counts, 0 where undefined."""
    named = counts.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    x = named.join(counts, (F.col("label") == F.col("true_label")) | (F.col("label") == F.col("predicted_label")), "left")
    hit = F.when((F.col("label") == F.col("true_label")) & (F.col("label") == F.col("predicted_label")), F.col("n"))
    g = x.groupBy("label").agg(total(hit, "tp"), total(F.when(F.col("label") == F.col("predicted_label"), F.col("n")), "p"), total(F.when(F.col("label") == F.col("true_label"), F.col("n")), "support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("p"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return g.select("label", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1_score"), "support")


def metrics_of(counts: Mapping[tuple[str, str], int], labels: list[str], noise_label: str = NOISE) -> dict[str, Any]:
    """All scores from counts of (true, predicted): over the given labels, accuracy over all rows."""
    total = sum(counts.values())
    right = sum(n for (t, p), n in counts.items() if t == p)
    precision, recall, f1 = {}, {}, {}
    for x in labels:
        tp = counts.get((x, x), 0)
        predicted = sum(n for (_, p), n in counts.items() if p == x)
        actual = sum(n for (t, _), n in counts.items() if t == x)
        precision[x] = tp / predicted if predicted else 0.0
        recall[x] = tp / actual if actual else 0.0
        f1[x] = 2 * precision[x] * recall[x] / (precision[x] + recall[x]) if precision[x] + recall[x] else 0.0
    mean = lambda d: sum(d.values()) / len(d) if d else 0.0
    noise = sum(n for (t, p), n in counts.items() if t != p and p == noise_label)
    matrix = np.array([[counts.get((t, p), 0) for p in labels] for t in labels])
    lines = [f"{x}: precision {precision[x]:.3f}, recall {recall[x]:.3f}, f1 {f1[x]:.3f}" for x in labels]
    errors = total - right
    return {"accuracy": right / total if total else 0.0, "precision": precision, "recall": recall, "f1_score": f1, "macro_precision": mean(precision), "macro_recall": mean(recall), "macro_f1": mean(f1), "confusion_matrix": matrix, "classification_report": "\n".join(lines), "total_errors": errors, "noise_errors": noise, "hard_errors": errors - noise, "noise_error_share": noise / errors if errors else 0.0}


def _score(predictions: DataFrame, truth: Mapping[Any, str], labels: list[str]) -> tuple[dict[str, Any], DataFrame]:
    kind = predictions.schema["node_id"].dataType.simpleString()
    rows = predictions.sparkSession.createDataFrame(list(truth.items()), f"node_id {kind}, true_label string")
    own = predictions.join(small(rows), "node_id")
    counts = {(r[0], r[1]): r[2] for r in confusion(own, "true_label", "dominant_label").collect()}
    if (found := sum(counts.values())) < len(truth):
        raise ComputationError(f"{len(truth) - found} test nodes have no prediction", operation="validate")
    return metrics_of(counts, labels), own


def split_seeds(seeds: Mapping[Any, str], test_size: float, stratify: bool, seed: int | None) -> tuple[dict, dict]:
    """Train and test: a seeded shuffle, label by label if stratified and each has at least two."""
    rng = random.Random(seed)
    groups: dict[str, list] = defaultdict(list)
    for n, x in sorted(seeds.items(), key=lambda s: (s[1], str(s[0]))):
        groups[x if stratify else ""].append(n)
    if stratify and min(map(len, groups.values())) < 2:
        groups = {"": [n for g in groups.values() for n in g]}
    test = set()
    for g in groups.values():
        rng.shuffle(g)
        test.update(g[: min(len(g) - 1, max(1, round(test_size * len(g))))] if len(g) > 1 else [])
    return {n: x for n, x in seeds.items() if n not in test}, {n: x for n, x in seeds.items() if n in test}


def _pass(predictions: Any, directional_pass: str | None) -> DataFrame:
    if isinstance(predictions, tuple):
        if directional_pass not in ("out", "in"):
            raise ConfigurationError("a directional result needs directional_pass, out or in", parameter="directional_pass", value=directional_pass)
        return predictions[0 if directional_pass == "out" else 1]
    return predictions


def train_test_split_validation(graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], test_size: float = 0.2, stratify: bool = True, random_seed: int | None = None, seed_node_col: str = "node_id", seed_label_col: str = "label", test_seeds: Any = None, propagator: Callable = guided_label_propagation, directional_pass: str | None = None, **glp_kwargs: Any) -> dict[str, Any]:
    """Hold out some seeds (or the given test_seeds), propagate the rest, and score the held-out."""
    seeds = normalize_seed_input(seed_labels, seed_node_col, seed_label_col)
    if test_seeds is not None:
        test = normalize_seed_input(test_seeds, seed_node_col, seed_label_col)
        if wrong := sorted(set(test.values()) - set(labels)):
            raise ValidationError(f"test seeds have unknown labels {wrong}", field="test_seeds", value=wrong)
        train = {n: x for n, x in seeds.items() if n not in test}
    else:
        if not 0 < test_size < 1:
            raise ConfigurationError("test_size must lie between 0 and 1", parameter="test_size", value=test_size)
        if len(seeds) < 2:
            raise ValidationError("a split needs at least 2 seeds", field="seed_labels")
        train, test = split_seeds(seeds, test_size, stratify, random_seed)
    train, test = known_seeds(train, id_mapper), known_seeds(test, id_mapper)
    if not train or not test:
        raise ValidationError("no training or no test seed is in the graph", field="seed_labels")
    predictions = _pass(propagator(graph, id_mapper, train, labels, **glp_kwargs), directional_pass)
    scores, own = _score(predictions, test, labels)
    return scores | {"test_predictions": own.drop("true_label"), "misclassified_predictions": own.where("dominant_label <> true_label"), "train_size": len(train), "test_size": len(test)}


def external_validation(predictions: DataFrame, validation_labels: Any, labels: list[str], seed_node_col: str = "node_id", seed_label_col: str = "label") -> dict[str, Any]:
    """Score predictions against independent labels of nodes that have one."""
    truth = normalize_seed_input(validation_labels, seed_node_col, seed_label_col)
    kind = predictions.schema["node_id"].dataType.simpleString()
    rows = predictions.sparkSession.createDataFrame(list(truth.items()), f"node_id {kind}, true_label string")
    own = predictions.join(small(rows), "node_id")
    counts = {(r[0], r[1]): r[2] for r in confusion(own, "true_label", "dominant_label").collect()}
    if not counts:
        raise ValidationError("no labelled node has a prediction", field="validation_labels")
    return metrics_of(counts, labels) | {"test_predictions": own.drop("true_label"), "validation_size": sum(counts.values())}


def get_validation_summary(validation_results: Mapping[str, Any]) -> str:
    r = validation_results
    lines = [f"accuracy {r['accuracy']:.3f}, macro f1 {r['macro_f1']:.3f}, macro precision {r['macro_precision']:.3f}, macro recall {r['macro_recall']:.3f}"]
    lines += [f"train {r['train_size']}, test {r['test_size']}"] if "train_size" in r else [f"validated {r['validation_size']}"] if "validation_size" in r else []
    lines.append(f"errors {r['total_errors']}, of these noise {r['noise_errors']}")
    lines += [f"  {x}: precision {r['precision'][x]:.3f}, recall {r['recall'][x]:.3f}, f1 {f:.3f}" for x, f in r["f1_score"].items()]
    return "\n".join(lines)


def folds(seeds: Mapping[Any, str], k: int, stratify: bool, seed: int | None) -> list[tuple[dict, dict]]:
    """k (train, test) pairs; stratified ones deal each label's shuffled seeds round by round."""
    rng = random.Random(seed)
    groups: dict[str, list] = defaultdict(list)
    for n, x in sorted(seeds.items(), key=lambda s: (s[1], str(s[0]))):
        groups[x if stratify else ""].append(n)
    part, at = {}, 0
    for g in groups.values():
        rng.shuffle(g)
        for n in g:
            part[n] = at % k
            at += 1
    return [({n: x for n, x in seeds.items() if part[n] != i}, {n: x for n, x in seeds.items() if part[n] == i}) for i in range(k)]


def aggregate_folds(fold_results: list[dict[str, Any]], labels: list[str], k_folds: int) -> dict[str, Any]:
    """Means, sample deviations and pooled errors over folds."""
    std = lambda v: float(np.std(v, ddof=1)) if len(v) > 1 else 0.0
    accuracy = [r["accuracy"] for r in fold_results]
    macro = [r["macro_f1"] for r in fold_results]
    out: dict[str, Any] = {"mean_accuracy": float(np.mean(accuracy)), "std_accuracy": std(accuracy), "fold_accuracies": accuracy}
    for short, name in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score")):
        values = {x: [r[name][x] for r in fold_results] for x in labels}
        out |= {f"mean_{short}": {x: float(np.mean(v)) for x, v in values.items()}, f"std_{short}": {x: std(v) for x, v in values.items()}}
    errors, noise = sum(r["total_errors"] for r in fold_results), sum(r["noise_errors"] for r in fold_results)
    return out | {"mean_macro_f1": float(np.mean(macro)), "std_macro_f1": std(macro), "fold_results": fold_results, "aggregate_confusion_matrix": sum(r["confusion_matrix"] for r in fold_results), "k_folds": k_folds, "total_errors": errors, "noise_errors": noise, "hard_errors": errors - noise, "noise_error_share": noise / errors if errors else 0.0, "fold_noise_error_shares": [r["noise_error_share"] for r in fold_results]}


def cross_validate(graph: EdgeList, id_mapper: IDMapper, seed_labels: Any, labels: list[str], k_folds: int = 5, stratify: bool = True, random_seed: int | None = None, n_jobs: int = 1, seed_node_col: str = "node_id", seed_label_col: str = "label", propagator: Callable = guided_label_propagation, directional_pass: str | None = None, **glp_kwargs: Any) -> dict[str, Any]:
    """k-fold validation over the seeds in the graph; n_jobs folds run at once, as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    if k_folds < 2:
        raise ConfigurationError("there must be at least 2 folds", parameter="k_folds", value=k_folds)
    seeds = known_seeds(normalize_seed_input(seed_labels, seed_node_col, seed_label_col), id_mapper)
    if len(seeds) < k_folds:
        raise ValidationError(f"{k_folds} folds need as many seeds", field="seed_labels", value=len(seeds))

    def one(pair: tuple[dict, dict]) -> dict[str, Any]:
        train, test = pair
        predictions = _pass(propagator(graph, id_mapper, train, labels, **glp_kwargs), directional_pass)
        return _score(predictions, test, labels)[0] | {"train_size": len(train), "test_size": len(test)}

    with ThreadPoolExecutor(max(1, n_jobs if n_jobs > 0 else 4)) as pool:
        found = list(pool.map(one, folds(seeds, k_folds, stratify, random_seed)))
    return aggregate_folds(found, labels, k_folds)

