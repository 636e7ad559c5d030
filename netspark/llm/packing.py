"""Bounded-space online packing of documents into token windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm import _scratch
from netspark.llm._tokens import WORD, chunks, raw, string_column

#: Tokens of a window, open windows of a partition, documents of a partition, partitions (then groups of them) whose leftovers one task merges.
CAPACITY, OPEN, BLOCK, MERGE = 2048, 16, 65536, 256
#: Ranges of hashes in which documents are numbered.
RANGES = 4096
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def count_tokens(column: pa.Array) -> np.ndarray:
    """Tokens of each row: words (runs of letters, digits, underscores and non-ASCII characters) and single other characters but white space."""
    out = np.zeros(len(column), np.int64)
    for a, b in chunks(column):
        data, offsets = raw(column.slice(a, b - a))
        if not len(data):
            continue
        word = WORD[data]
        token = ~SPACE[data]
        inside = np.zeros(len(data), bool)
        inside[1:] = word[1:] & word[:-1]
        inside[offsets[offsets < len(data)]] = False
        sums = np.concatenate([[0], np.cumsum(token & ~inside)])
        out[a:b] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out


def tokenizer_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts the tokens of a public tokenizer's tokenizer.json at path, which executors must see."""

    def count(column: pa.Array) -> np.ndarray:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return np.array([len(x.ids) for x in tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)], np.int64)

    return count


class Packer:
    """Open windows of one partition, each a list of pieces (doc, start, length)."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.open: list[tuple[int, list]] = []

    def add(self, piece: tuple) -> list | None:
        """Place a piece best-fit: in the fullest window that has room, the oldest of equals. If none has, a new one opens, and if all may be open already, the fullest (the oldest of equals) is closed and returned."""
        size, best = piece[2], None
        for i, (used, _) in enumerate(self.open):
            if used + size <= self.capacity and (best is None or used > self.open[best][0]):
                best = i
        if best is not None:
            used, pieces = self.open[best]
            pieces.append(piece)
            self.open[best] = (used + size, pieces)
            return self.open.pop(best)[1] if used + size == self.capacity else None
        closed = None
        if len(self.open) == self.most_open:
            closed = self.open.pop(max(range(len(self.open)), key=lambda i: (self.open[i][0], -i)))[1]
        self.open.append((size, [piece]))
        return closed


def pack_block(docs: Iterator[tuple], capacity: int, most_open: int) -> tuple[list, list]:
    """Closed windows and leftovers of one partition's (doc, tokens) in order; full windows are cut off documents longer than one."""
    packer, closed = Packer(capacity, most_open), []
    for doc, tokens in docs:
        for start in range(0, tokens, capacity):
            piece = (doc, start, min(capacity, tokens - start))
            if piece[2] == capacity:
                closed.append([piece])
            elif (done := packer.add(piece)) is not None:
                closed.append(done)
    return closed, [pieces for _, pieces in packer.open]


def merge_leftovers(leftovers: list[list], capacity: int) -> list[list]:
    """Leftover windows put together, the fullest first (then by first piece), each into the fullest merged window with room."""
    used: list[int] = []
    merged: list[list] = []
    for pieces in sorted(leftovers, key=lambda w: (-sum(p[2] for p in w), w[0])):
        size = sum(p[2] for p in pieces)
        fits = [i for i, u in enumerate(used) if u + size <= capacity]
        if fits:
            i = max(fits, key=lambda i: (used[i], -i))
            used[i] += size
            merged[i] = merged[i] + pieces
        else:
            used.append(size)
            merged.append(list(pieces))
    return merged


def numbered(sizes: DataFrame, block: int) -> DataFrame:
    """``block, doc_id, n, copies``: documents (doc_id, n tokens) numbered in the order of a hash of both, then of themselves, in blocks of so many numbers.

    Equal rows are one entry with their number, which is cut where blocks end,
    so neither sparse ids nor rows that repeat make a block larger or smaller
    than others. Ranges of hashes are sorted each by itself.
    """
    one = sizes.groupBy("doc_id", "n").agg(F.count("*").alias("copies")).withColumn("range", F.pmod(F.xxhash64("doc_id", "n"), F.lit(RANGES)))
    order = Window.partitionBy("range").orderBy("doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    one = _scratch.write(one.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))), "sizes")
    first = one.groupBy("range").agg(F.sum("copies").alias("all")).select("range", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    at = one.join(F.broadcast(first), "range").withColumn("first", F.col("first") + F.col("before"))  # RANGES rows at any size
    last = F.col("first") + F.col("copies") - 1
    cut = at.select("doc_id", "n", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(last / block))).alias("block"))
    return cut.select("block", "doc_id", "n", (F.least("last", F.col("block") * block + block - 1) - F.greatest("first", F.col("block") * block) + 1).alias("copies"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, most_open: int = OPEN, block: int = BLOCK, merge: int = MERGE, counter: Callable[[pa.Array], np.ndarray] = count_tokens) -> DataFrame:
    """Windows of at most capacity tokens that hold every token of docs once.

    ``window_id`` (string: level, block and number within it), ``n_tokens``,
    ``n_docs``, ``merged`` (made of leftovers), and the parallel arrays
    ``doc_ids``, ``starts`` and ``lengths`` in tokens. A partition is a block
    of numbered() documents in the order of ids, so the result depends neither
    on how the table is split nor on gaps between ids; its open windows are left
    over. Leftovers of merge blocks are merged by one task, which leaves the most_open
    emptiest of its windows to the next level, until one task merges the last.
    Only ids and token counts are shuffled. Null ids, null and empty texts and texts of only
    white space have no piece; a text longer than a window fills windows of its own and one more piece; rows that repeat an id are packed one by one,
    those of equal ids by their token count; an empty table gives no windows;
    extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    counted = T.StructType([T.StructField("doc_id", id_type), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(string_column(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], counted.names).filter(pa.array(n > 0))

    sizes = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(count, counted)
    window = T.StructType([T.StructField("block", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("left", T.BooleanType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType()))])

    def table(block_: int, windows: list[list], left: list[bool], like: pa.DataType) -> pa.Table:
        columns = [[[p[k] for p in w] for w in windows] for k in range(3)]
        return pa.table([pa.array([block_] * len(windows), pa.int64()), pa.array(range(len(windows)), pa.int64()), pa.array(left, pa.bool_()), pa.array(columns[0], pa.list_(like)), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.int64()))], names=window.names)

    def one_block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        every = ((d, n) for d, n, k in zip(*(rows[c].to_pylist() for c in ("doc_id", "n", "copies")), strict=True) for _ in range(k))
        closed, left = pack_block(every, capacity, most_open)
        return table(key[0].as_py(), closed + left, [False] * len(closed) + [True] * len(left), rows["doc_id"].type)

    def one_merge(last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            pieces = [list(zip(d, s, n, strict=True)) for d, s, n in zip(rows["doc_ids"].to_pylist(), rows["starts"].to_pylist(), rows["lengths"].to_pylist(), strict=True)]
            windows = merge_leftovers(pieces, capacity)
            rank = sorted(range(len(windows)), key=lambda i: (sum(p[2] for p in windows[i]), windows[i][0]))
            again = set() if last else set(rank[:most_open])
            return table(key[0].as_py(), windows, [i in again for i in range(len(windows))], rows["doc_ids"].type.value_type)

        return run

    shape = ["doc_ids", "starts", "lengths"]
    made, level, found = _scratch.write(numbered(sizes, block).groupBy("block").applyInArrow(one_block, window), "windows"), 0, []
    while True:
        found.append(made.where("NOT left").select(F.concat_ws("-", F.lit("w" if level == 0 else f"m{level}"), "block", "seq").alias("window_id"), F.lit(level > 0).alias("merged"), *shape))
        left = made.where("left")
        blocks = left.agg(F.max("block")).first()[0]
        if blocks is None:
            break
        level += 1
        merged = left.withColumn("block", F.floor(F.col("block") / merge)).select("block", *shape).groupBy("block").applyInArrow(one_merge(blocks < merge), window)
        made = _scratch.write(merged, "windows")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda t, x: t + x)
    return reduce(DataFrame.unionByName, found).select("window_id", total.alias("n_tokens"), F.size(F.array_distinct("doc_ids")).alias("n_docs"), "merged", *shape)
