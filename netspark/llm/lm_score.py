"""Cross-entropy difference between two n-gram models of words over one vocabulary."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netspark.llm import _scratch
from netspark.llm._tokens import Splitter, U, chunks, mix, raw, string_column

#: Weight of the unigrams in a bigram's estimate, in counts, and count that every word of the vocabulary has beside its own.
WEIGHT, ADDED = 5.0, 0.5
#: Bytes of text whose grams one task asks for together, and bytes of text for every range of grams that one task counts.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Tasks of a stage at most; each then has several ranges or blocks, one after the other.
MOST_TASKS = 20_000
#: What stands before a text's first word: no hash of a word, which have 48 bits. Grams have 56.
START, WORD_SHIFT, GRAM_SHIFT = U(1 << 48), U(16), U(8)
_WORDS, _PAIRS = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, low bytes first, which compress apart."""
    x = x.astype(U)
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([size]) + x.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    size = planes[0]
    x = np.frombuffer(planes, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :size] = x.T
    return out.view(U).ravel()


def _sorted(x: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return _planes(np.diff(x, prepend=U(0)))


def _ascending(planes: bytes) -> np.ndarray:
    return np.cumsum(_numbers(planes), dtype=U)


def _packed(x: Any) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def _opened(x: bytes) -> Any:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _before(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The word before each word of texts of n words each, START before the first."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    begin = (np.cumsum(n) - n)[n > 0]
    out[begin] = START
    return out


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIRS + token) >> GRAM_SHIFT


def _singles(word: np.ndarray) -> np.ndarray:
    return mix(word ^ _WORDS) >> GRAM_SHIFT


class Block:
    """Some documents of a task: ids, marks of the target, and the hash of every word."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.marks: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.token: list[np.ndarray] = []
        self.bytes = 0

    def rows(self, block: int, ranges: int) -> tuple[list[tuple], dict]:
        """``to, block, blob`` rows: the block's documents, and for every range of grams its distinct ones with their counts; and the block's sums."""
        n, mark, token = np.concatenate(self.n), np.concatenate(self.marks), np.concatenate(self.token)
        word, local, times = np.unique(token, return_inverse=True, return_counts=True)
        own = np.repeat(mark, n)
        common = np.argsort(-times, kind="stable")  # frequent words get small numbers
        place = np.empty(len(word), np.int64)
        place[common] = np.arange(len(word))
        key, pair_of = np.unique(_pairs(_before(token, n), token), return_inverse=True)
        sent = [(_singles(word), times, np.bincount(local[own], minlength=len(word))), (key, np.bincount(pair_of, minlength=len(key)), np.bincount(pair_of[own], minlength=len(key)))]
        order = np.argsort(sent[0][0])
        sent[0] = tuple(x[order] for x in sent[0])
        width = U(2**56 // ranges + 1)
        cuts = [np.searchsorted(k // width, np.arange(ranges + 1).astype(U)) for k, *_ in sent]
        out = [(int(mix(np.array([block], U))[0] % U(ranges)), block, _packed(("docs", pa.concat_arrays(self.ids), _planes(n), _sorted(word), _planes(common), _planes(place[local]))))]
        for r in range(ranges):
            if any(c[r + 1] > c[r] for c in cuts):
                out.append((r, block, _packed(("ask", *[(_sorted(k[c[r] : c[r + 1]]), _planes(b[c[r] : c[r + 1]]), _planes(t[c[r] : c[r + 1]])) for (k, b, t), c in zip(sent, cuts, strict=True)]))))
        texts = n > 0
        return out, {"background": int(n.sum() + texts.sum()), "target": int(own.sum() + texts[mark].sum()), "texts": int(texts.sum()), "target_texts": int(texts[mark].sum())}


_SUMS = ("background", "target", "texts", "target_texts", "vocabulary")
_SENT = "to long, block long, blob binary, " + ", ".join(f"{c} long" for c in _SUMS)


def _batch(rows: list[tuple], sums: dict | None = None) -> pa.RecordBatch:
    """Rows of _SENT; the sums stand in the first."""
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    values = [pa.array([(sums or {}).get(c, 0), *[0] * (len(rows) - 1)][: len(rows)], pa.int64()) for c in _SUMS]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), *values], ["to", "block", "blob", *_SUMS])


def _asked(ranges: int, block_bytes: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, now, number = Splitter(), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            column, mark = string_column(batch.column(1)), np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for a, b in chunks(column):
                words = splitter.words(column.slice(a, b - a))
                now.ids.append(batch.column(0).slice(a, b - a))
                now.marks.append(mark[a:b])
                now.n.append(np.diff(words.first))
                now.token.append(words.hash >> WORD_SHIFT)
                now.bytes += int(raw(column.slice(a, b - a))[1][-1])
                if now.bytes >= block_bytes:
                    yield _batch(*now.rows(number, ranges))
                    now, number = Block(), number + 1
        if now.ids:
            yield _batch(*now.rows(number, ranges))

    return run


def _totals(asks: list[tuple], kind: int) -> tuple[list[tuple[bytes, bytes]], int]:
    """For every asking block the counts over all blocks of the grams it asks for, and the number of distinct grams."""
    keys = [_ascending(a[kind][0]) for a in asks]
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    del key, keys
    found = []
    for i in (1, 2):
        own = np.concatenate([_numbers(a[kind][i]).astype(np.int64) for a in asks])
        total = np.zeros(len(begin), np.int64)
        np.add.at(total, group, own)
        found.append([_planes(x) for x in np.split(total[group], cuts)])
    return list(zip(*found, strict=True)), len(begin)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to the blocks of each range of grams; documents pass through, on their way to the blocks' next task."""

    def answers(to: int, blocks: list[int], asks: list[tuple]) -> pa.RecordBatch:
        (words, distinct), (pairs, _) = _totals(asks, 0), _totals(asks, 1)
        return _batch([(to, b, _packed(("counts", to, w, p))) for b, w, p in zip(blocks, words, pairs, strict=True)], {"vocabulary": distinct})

    now, blocks, asks = None, [], []
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), *(c.to_pylist() for c in batch.columns[3:]), strict=True)
        for to, block, blob, *sums in rows:
            blob = blob.as_py()
            if to != now and asks:
                yield answers(now, blocks, asks)
                blocks, asks = [], []
            now = to
            what, *rest = _opened(blob)
            if what == "docs":
                yield _batch([(to, block, blob)], dict(zip(_SUMS, sums, strict=True)))
            else:
                blocks.append(block)
                asks.append(tuple(rest))
    if asks:
        yield answers(now, blocks, asks)


def losses(counts: np.ndarray, pairs: np.ndarray, local: np.ndarray, pair_of: np.ndarray, n: np.ndarray, total: int, texts: int, vocabulary: int, weight: float, added: float) -> np.ndarray:
    """-ln P of every word under one model: its bigram's count and weight times its unigram estimate, to the count of the word before and weight."""
    one = (counts + added) / (total + added * (vocabulary + 1))
    before = np.empty(len(local))
    before[1:] = counts[local[:-1]]
    before[(np.cumsum(n) - n)[n > 0]] = texts
    return -np.log((pairs[pair_of] + weight * one[local]) / (before + weight))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: float = WEIGHT, added: float = ADDED, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """How much better each text is told by a model of the target documents than by one of all.

    ``doc_id, n_tokens, target_loss, background_loss, score``: losses are mean
    nats per word under two bigram models that share smoothing and one
    vocabulary, the distinct words of docs; score is target_loss -
    background_loss, low for texts like the target. target has ids (column of
    the same name). A word's estimate is (c(v w) + weight P(w)) / (c(v) +
    weight) after v, with P(w) = (c(w) + added) / (N + added (V + 1)); N has the
    ends of texts as well, and before a first word c(v) is the number of texts.

    All counts are of all documents and are never on the driver: every task
    sends the distinct grams of its blocks, counted, to the tasks of their
    ranges, which send back the totals; a block's words follow as small
    numbers, so texts aren't shuffled. A gram that all texts have is one
    entry a block. Equal hashes, of 48 bits a word and 56 a gram, count as one.

    Null texts and texts without a word have n_tokens 0 and null losses; a very
    long text is a block of its own; null ids are scored and never in the
    target; rows that repeat an id all count; with an empty target its
    model is uniform; an empty table gives no rows; extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    marked = plain.join(_scratch.hinted(target.select(F.col(id_col).alias("id"), F.lit(True).alias("mark")).distinct()), "id", "left").select("id", "text", F.coalesce("mark", F.lit(False)).alias("mark"))
    asked = marked.mapInArrow(_asked(ranges, block_bytes), _SENT)
    tasks = min(ranges, MOST_TASKS)
    counted = asked.repartition(tasks, "to").sortWithinPartitions("to").mapInArrow(_counted, _SENT)
    table, sums = _scratch.measured(counted, "lm", *[F.sum(c).alias(c) for c in _SUMS])
    found = {c: sums[c] or 0 for c in _SUMS}
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score")]])

    def score(blobs: list[bytes]) -> pa.RecordBatch:
        rows = [_opened(b) for b in blobs]
        (_, ids, n, word, common, local), = [r for r in rows if r[0] == "docs"]
        n, word = _numbers(n).astype(np.int64), _ascending(word)
        local = _numbers(common).astype(np.int64)[_numbers(local).astype(np.int64)]
        replies = sorted([r[1:] for r in rows if r[0] == "counts"], key=lambda r: r[0])
        counts = [[np.concatenate([np.zeros(0, U), *[_numbers(r[1 + k][i]) for r in replies]]).astype(float) for k in range(2)] for i in range(2)]
        token = word[local]
        pair_of = np.unique(_pairs(_before(token, n), token), return_inverse=True)[1]
        order = np.argsort(_singles(word))
        place = np.empty(len(word), np.int64)
        place[order] = np.arange(len(word))
        some = np.flatnonzero(n)
        begin = (np.cumsum(n) - n)[some]
        mean = np.zeros((2, len(n)))
        for i, (total, texts) in enumerate((("background", "texts"), ("target", "target_texts"))):
            if len(some):
                each = losses(counts[i][0][place], counts[i][1], local, pair_of, n, found[total], found[texts], found["vocabulary"], weight, added)
                mean[i, some] = np.add.reduceat(each, begin) / n[some]
        none = n == 0
        return pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(n), *[pa.array(x, mask=none) for x in (mean[1], mean[0], mean[1] - mean[0])]], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now and blobs:
                    yield score(blobs)
                    blobs = []
                now = block
                blobs.append(blob.as_py())
        if blobs:
            yield score(blobs)

    return table.select("block", "blob").repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(run, schema)


def oracle_sql(target: str, digits: int = 6, weight: float = WEIGHT, added: float = ADDED) -> str:
    """DuckDB SQL of cross_entropy_difference() with rounded losses; target is a query of doc_ids."""

    def loss(m: str) -> str:
        one = f"(c.{m} + {added!r}) / (n.{m} + {added!r} * (n.v + 1))"
        return f"avg(-ln((p.{m} + {weight!r} * {one}) / (h.{m} + {weight!r})))"

    return f"""
WITH target AS ({target}),
d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM target) AS own, regexp_extract_all(lower(text), '[0-9a-z_\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT doc_id, own, unnest(list_prepend('', w[1:len(w) - 1])) AS a, unnest(w) AS b FROM d WHERE len(w) > 0),
words AS (SELECT b AS w, count(*) AS t, count(*) FILTER (own) AS o FROM g GROUP BY b),
pairs AS (SELECT a, b, count(*) AS t, count(*) FILTER (own) AS o FROM g GROUP BY a, b),
starts AS (SELECT '' AS w, count(*) AS t, count(*) FILTER (own) AS o FROM d WHERE len(w) > 0),
before AS (SELECT * FROM words UNION ALL SELECT * FROM starts),
n AS (SELECT sum(t) AS t, sum(o) AS o, count(*) - 1 AS v FROM before),
l AS (SELECT doc_id, count(*) AS n_tokens, {loss("o")} AS target_loss, {loss("t")} AS background_loss FROM g JOIN words c ON c.w = g.b JOIN pairs p ON p.a = g.a AND p.b = g.b JOIN before h ON h.w = g.a CROSS JOIN n GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, round(target_loss, {digits}) AS target_loss, round(background_loss, {digits}) AS background_loss, round(target_loss - background_loss, {digits}) AS score FROM documents LEFT JOIN l USING (doc_id)
"""
