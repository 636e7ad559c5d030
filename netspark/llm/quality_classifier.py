"""Regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm import _scratch
from netspark.llm._tokens import U, Splitter, chunks, raw, string_column

#: At most so many labelled documents of each class are fitted on, those of the least hashes.
SAMPLE = 10_000
#: Share of the good documents of the sample that the threshold keeps at least.
GOOD_RECALL = 0.995
FEATURES = ("words", "word_mean", "word_sd", "upper", "digit", "symbol", "punctuation", "space", "line", "short", "foreign", "distinct", "repeat", "top", "chunk_distinct")
_CLASS = np.zeros((8, 256), bool)
for _row, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_|~", b".,;:!?'\"()-", b" \t\r\n\v\f", b"\n", range(128, 256))):
    _CLASS[_row, list(_set)] = True
del _row, _set
CODE = (_CLASS * (1 << np.arange(8))[:, None]).sum(axis=0).astype(np.uint8)


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def statistics(column: pa.Array, splitter: Splitter | None = None) -> np.ndarray:
    """FEATURES of each row, on scales where they are roughly normal: logarithms of sizes, log odds of shares."""
    splitter = splitter or Splitter()
    out = np.zeros((len(column), len(FEATURES)))
    for a, b in chunks(column):
        part = column.slice(a, b - a)
        data, offsets = raw(part)
        n = np.diff(offsets).astype(float)
        code = CODE[data]
        count = []
        for bit in range(8):
            sums = np.concatenate([[0], np.cumsum((code >> bit) & 1, dtype=np.int64)])
            count.append((sums[offsets[1:]] - sums[offsets[:-1]]).astype(float))
        lower, upper, digit, symbol, punctuation, space, line, foreign = count
        words = splitter.words(part)
        w = np.diff(words.first).astype(float)
        size = (words.end - words.start).astype(float)

        def total(x: np.ndarray, first: np.ndarray = words.first) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(x)])
            return sums[first[1:]] - sums[first[:-1]]

        mean = total(size) / np.maximum(w, 1)
        sd = np.sqrt(np.maximum(total(size * size) / np.maximum(w, 1) - mean**2, 0))
        same = np.zeros(len(size))
        if len(size) > 1:
            same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        # Distinct words of a row, and within stretches of 64 words, which long rows repeat less.
        distinct, top = _distinct(words.row, words.hash, b - a)
        stretch = np.zeros(len(size), np.int64)
        if len(size):
            place = np.arange(len(size)) - words.first[words.row]
            begin = place % 64 == 0
            stretch = np.cumsum(begin) - 1
            near, _ = _distinct(stretch, words.hash, int(stretch[-1]) + 1)
            owner = words.row[np.flatnonzero(begin)]
            near = np.bincount(owner, weights=near, minlength=b - a)
        else:
            near = np.zeros(b - a)
        letters = lower + upper
        out[a:b] = np.stack([np.log1p(w), np.log1p(mean), np.log1p(sd), _logit(upper, letters), _logit(digit, n), _logit(symbol, n), _logit(punctuation, n), _logit(space, n), _logit(line, w + 1), _logit(total(size <= 3), w), _logit(foreign, n), _logit(distinct, w), _logit(total(same), w), _logit(top, w), _logit(near, w)], axis=1)
    return out


def _distinct(row: np.ndarray, hash_: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of so many rows, and how often the most frequent occurs."""
    if not len(row):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(U) << U(40)) | (hash_ >> U(24)))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[begin] >> U(40)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, owner, np.diff(np.append(begin, len(key))))
    return np.bincount(owner, minlength=rows).astype(float), top


@dataclass
class Discriminant:
    """Two Gaussians with cached Cholesky factors; score is the log density of good less that of bad."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_determinants: np.ndarray
    threshold: float = 0.0

    def __post_init__(self) -> None:
        """The factors' inverses, once: a Mahalanobis distance is then one product of a triangular matrix."""
        self.inverses = [np.linalg.solve(f, np.eye(len(f))) for f in self.factors]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = []
        for mean, inverse, determinant in zip(self.means, self.inverses, self.log_determinants, strict=True):
            y = np.einsum("ij,kj->ik", z - mean, inverse)  # row by row, so that equal rows of any batch give equal bits
            density.append(-0.5 * (y * y).sum(axis=1) - 0.5 * determinant)
        return density[1] - density[0]


def fit(x: np.ndarray, good: np.ndarray, good_recall: float = GOOD_RECALL) -> Discriminant:
    """Class covariances shrink towards the pooled one, whose share falls with the class's size, and that towards its diagonal.

    A class without documents takes the pooled Gaussian, so all scores are 0.
    The threshold keeps at least good_recall of the good, and never rejects
    what is likelier good.
    """
    d = x.shape[1]
    center = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(d)
    z = (x - center) / scale
    groups = [z[~good], z[good]]
    pooled = sum(((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in groups if len(g)), np.zeros((d, d))) / max(len(z), 1)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 0.01 * np.eye(d)
    means, factors, determinants = [], [], []
    for g in groups:
        share = (d + 2) / (d + 2 + len(g))
        own = np.cov(g.T, bias=True) if len(g) > 1 and min(len(groups[0]), len(groups[1])) else pooled
        covariance = (1 - share) * own + share * pooled + 0.01 * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        means.append(g.mean(axis=0) if min(len(groups[0]), len(groups[1])) else np.zeros(d))
        factors.append(factor)
        determinants.append(2 * np.log(np.diag(factor)).sum())
    if not min(len(groups[0]), len(groups[1])):
        factors[1], determinants[1] = factors[0], determinants[0]
    model = Discriminant(center, scale, np.array(means), np.array(factors), np.array(determinants))
    if good.any():
        model.threshold = min(0.0, float(np.quantile(model.score(x[good]), 1 - good_recall)))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and classes of at most sample documents of each label, 1 for good and 0 for bad; ids with labels that contradict each other are left out."""
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("id IS NOT NULL AND good IN (0, 1)").groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").select("id", "good")
    few = [clean.where(F.col("good") == g).orderBy(F.xxhash64("id"), "id").limit(sample) for g in (0, 1)]
    few = few[0].unionByName(few[1])
    schema = "good int, " + ", ".join(f"x{i} double" for i in range(len(FEATURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            x = statistics(string_column(batch.column(1)), splitter)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in x.T]], ["good", *[f"x{i}" for i in range(x.shape[1])]])

    # The sample is bounded by a parameter, so its ids may be broadcast.
    table = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL").join(_scratch.hinted(few), "id").select("good", "text").mapInArrow(run, schema).toArrow()
    x = np.stack([table[f"x{i}"].to_numpy() for i in range(len(FEATURES))], axis=1) if len(table) else np.zeros((0, len(FEATURES)))
    good = table["good"].to_numpy() == 1
    order = np.lexsort((*x.T, good))
    return x[order], good[order]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, good_recall: float = GOOD_RECALL) -> DataFrame:
    """``doc_id, score, keep`` of every row of docs, by a discriminant fitted on labels.

    Two narrow passes: one over the labelled sample, one that scores all rows
    with a model of constant size. keep is score >= threshold. Null and empty
    texts have a null score and aren't kept; null ids pass through; equal texts
    score alike; without labels of both classes all scores are 0 and all
    texts are kept; very long texts count whole; an empty table gives no rows; extra columns are ignored.
    """
    model = fit(*labelled_sample(docs, labels, id_col, text_col, label_col, sample), good_recall)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            column = string_column(batch.column(1))
            score = model.score(statistics(column, splitter))
            empty = np.diff(raw(column)[1]) == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, mask=empty), pa.array((score >= model.threshold) & ~empty)], schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
