"""Sharding by balanced label propagation over linked documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm import _scratch
from netspark.llm._tokens import Splitter, U, Words, chunks, mix, shingles, signed, string_column
from netspark.llm.lm_score import _ascending, _numbers, _opened, _packed, _planes, _sorted

#: Shards, share by which one may exceed the mean, rounds at most, words of a shingle, consecutive shingles (a power of two) of which the least links documents.
SHARDS, SLACK, ROUNDS, SHINGLE, WINDOW = 16, 0.05, 20, 8, 32
#: Rounds end when fewer than this share of the linked documents moves.
STILL = 0.001
#: Parts of a quota: candidates of equal gain are admitted by such parts of their hashes.
PARTS = 256
#: Gains are told apart by their powers of two, up to this one.
MOST_GAIN = 15
#: Memberships (a document in a group) that one task works on together, for 16 shards or fewer.
PART_ROWS = 100_000


def winnowed(x: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of every run of window shingles of a row, or all of a row's if they are fewer, and its row; runs that follow each other mostly share theirs."""
    if not len(x):
        return x, row
    least, length = x, 1
    while length < window:
        least = np.minimum(least[: len(least) - length], least[length:])
        length *= 2
    within = row[: len(least)] == row[window - 1 :] if len(least) else np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    short = np.diff(np.append(begin, len(row))) < window
    few = np.repeat(short, np.diff(np.append(begin, len(row))))
    out, own = np.concatenate([least[within], x[few]]), np.concatenate([row[: len(least)][within], row[few]])
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return out[new], own[new]


def whole_texts(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of all words in order of each row that has some, but fewer than k, and its row."""
    n = np.diff(words.first)
    row = np.flatnonzero((n > 0) & (n < k))
    if not len(row):
        return np.zeros(0, U), row
    n, first = n[row], words.first[row]
    begin = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(begin, n)
    placed = mix(words.hash[np.repeat(first, n) + place] + place.astype(U) * U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(placed, begin) + n.astype(U)), row


def holders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """``x, y, doc_id, weight``: the documents of every group that holds the same winnowed k-word shingles, and how many of them.

    Of every window consecutive shingles the one of the least hash counts, so
    any passage of k + window - 1 words that two documents share links them,
    wherever it stands; of shorter texts all shingles count, and of those under
    k words all words together. Every
    holder of a shingle takes part: a group stands for the links between all
    its pairs, in one row a member. Shingles with the same holders are one
    group, named by two hashes of those; shingles with one holder are left out.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("shingle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            column = string_column(batch.column(1))
            for a, b in chunks(column):
                words = splitter.words(column.slice(a, b - a))
                x, at = shingles(words, k)
                x, row = (np.concatenate(both) for both in zip(winnowed(x, words.row[at], window), whole_texts(words, k), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), pa.array(signed(x))], schema.names)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)
    # One shuffle for all: a shingle's rows are made distinct, counted and named where they are, which spills beyond memory. A shingle of very many documents is one task's.
    group = Window.partitionBy("shingle")
    named = rows.repartition("shingle").distinct().select("doc_id", F.count("*").over(group).alias("n"), *[F.bit_xor(F.xxhash64("doc_id", F.lit(i))).over(group).alias(c) for i, c in enumerate("xy")])
    return named.where("n > 1").groupBy("x", "y", "doc_id").agg(F.count("*").alias("weight"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """``a < b, weight``: all pairs of documents that share winnowed k-word shingles, and how many; n documents of one group give n(n-1)/2 rows, so shard() works on holders()."""
    rows = _scratch.write(holders(docs, id_col, text_col, k, window), "holders")
    pairs = rows.select("x", "y", F.col("doc_id").alias("a"), "weight").join(rows.select("x", "y", F.col("doc_id").alias("b")), ["x", "y"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., n[0] of them, then those from begin[1], and so on."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def turned(hash_: np.ndarray, turn: int) -> np.ndarray:
    """Spark's xxhash64(doc_id, turn) from xxhash64(doc_id), for a turn of type int."""
    p1, p2, p3, p5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)
    x = (hash_.view(U) + p5 + U(4)) ^ (np.array([turn], U) * p1)
    x = ((x << U(23)) | (x >> U(41))) * p2 + p3
    x = (x ^ (x >> U(33))) * p2
    x = (x ^ (x >> U(29))) * p3
    return signed(x ^ (x >> U(32)))


class Part:
    """Documents of one part, their groups and their memberships: ``doc`` and ``group`` are places in ``number`` and ``ids``, which stand by the task that counts them, between its ``cuts``."""

    def __init__(self, number: np.ndarray, hash_: np.ndarray, ids: np.ndarray, cuts: np.ndarray, group: np.ndarray, doc: np.ndarray, weight: np.ndarray):
        self.number, self.hash, self.ids, self.cuts, self.group, self.doc, self.weight = number, hash_, ids, cuts, group, doc, weight

    @classmethod
    def of(cls, number: np.ndarray, hash_: np.ndarray, group: np.ndarray, weight: np.ndarray, parts: int) -> Part:
        number, first, doc = np.unique(number, return_index=True, return_inverse=True)
        ids, local = np.unique(group, return_inverse=True)
        order = np.argsort(ids % parts, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        local, by = place[local], np.argsort(place[local], kind="stable")
        return cls(number, hash_[first], ids[order], np.searchsorted(ids[order] % parts, np.arange(parts + 1)), local[by], doc[by], weight[by])

    def packed(self) -> bytes:
        return _packed((_sorted(self.number.astype(U)), self.hash, self.cuts, [_sorted(self.ids[a:b].astype(U)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)], _sorted(self.group.astype(U)), _planes(self.doc), self.weight))

    @classmethod
    def opened(cls, blob: bytes) -> Part:
        number, hash_, cuts, ids, group, doc, weight = _opened(blob)
        return cls(signed(_ascending(number)), hash_, np.concatenate([signed(_ascending(x)) for x in ids]), cuts, signed(_ascending(group)), signed(_numbers(doc)), weight)

    def asks(self, shard: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
        """For every counting task its groups' ids, in how many shards each has members here, and these shards and numbers of members."""
        cell, members = np.unique(self.group * shards + shard[self.doc], return_counts=True)
        group, at = cell // shards, cell % shards
        place = np.searchsorted(group, self.cuts)
        for to in np.flatnonzero(np.diff(self.cuts)).tolist():
            (a, b), (i, j) = self.cuts[to : to + 2], place[to : to + 2]
            yield to, _packed((_sorted(self.ids[a:b].astype(U)), _planes(np.bincount(group[i:j] - a, minlength=b - a)), _planes(at[i:j]), _planes(members[i:j])))

    def wishes(self, replies: list[tuple], shard: np.ndarray, shards: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard that each document would move to, -1 for none, and its rank by class of gain and part of hash; replies are those of answers(), by task."""
        n, at, members = (signed(np.concatenate([_numbers(r[i]) for r in replies])) for i in range(3))
        times = n[self.group]
        there = ranges((np.cumsum(n) - n)[self.group], times)
        doc, to = np.repeat(self.doc, times), at[there]
        others = members[there] - (to == shard[doc])  # a document is no neighbour of its own
        cell = (doc * shards + to)[others > 0]
        near = np.bincount(cell, (np.repeat(self.weight, times) * others)[others > 0], len(shard) * shards).reshape(-1, shards)
        near[np.bincount(cell, minlength=near.size).reshape(near.shape) == 0] = -np.inf
        row = np.arange(len(shard))
        best, own = near.argmax(axis=1), near[row, shard]
        gain = near[row, best] - np.where(own == -np.inf, 0, own)
        hash_ = turned(self.hash, turn)
        able = (gain > 0) & (best != shard) & (hash_ & 1 == 0)
        class_ = MOST_GAIN - np.minimum(np.frexp(np.where(able, gain, 1))[1] - 1, MOST_GAIN)
        return np.where(able, best, -1), class_ * PARTS + ((hash_ >> 1) & (PARTS - 1))


def answers(asks: list[bytes], shards: int) -> Iterator[bytes]:
    """For every part that asks, in how many shards each of its groups has members anywhere, and these shards and numbers of members."""
    rows = [_opened(a) for a in asks]
    ids = [signed(_ascending(r[0])) for r in rows]
    n, at, members = (signed(np.concatenate([_numbers(r[i]) for r in rows])) for i in (1, 2, 3))
    found, local = np.unique(np.concatenate(ids), return_inverse=True)
    cell, of = np.unique(np.repeat(local, n) * shards + at, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, of, members)
    n = np.bincount(cell // shards, minlength=len(found))
    begin = np.cumsum(n) - n
    for own in np.split(local, np.cumsum([len(i) for i in ids])[:-1]):
        there = ranges(begin[own], n[own])
        yield _packed((_planes(n[own]), _planes(cell[there] % shards), _planes(total[there])))


_PARTS = "key int, blob binary, now binary, wish array<bigint>, times array<bigint>"
_SENT = "key int, source int, blob binary, now binary"


def _table(schema: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], schema)


def _part_row(key: int, blob: bytes, shard: np.ndarray, to: np.ndarray, rank: np.ndarray, shards: int) -> pa.Table:
    """A row of _PARTS; wish is (rank x shards + to) x shards + shard, with how many documents have it."""
    some = to >= 0
    wish, times = np.unique((rank[some] * shards + to[some]) * shards + shard[some], return_counts=True)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return _table(["key", "blob", "now", "wish", "times"], kinds, [(key, blob, _packed((shard, to, rank)), wish, times)])


def _moved(now: bytes, upto: np.ndarray) -> np.ndarray:
    """Shards once those have moved whose rank is within what their shard admits."""
    shard, to, rank = _opened(now)
    return np.where((to >= 0) & (rank <= upto[to]), to, shard)


def parted(entries: DataFrame, parts: int, shards: int) -> DataFrame:
    """_PARTS of entries ``key, number, hash, group, weight``; documents begin in the shard of their number, and wish to stay there."""

    def pack(t: pa.Table) -> pa.Table:
        part = Part.of(*(t.column(c).to_numpy() for c in ("number", "hash", "group", "weight")), parts)
        shard = part.number % shards
        return _part_row(t.column("key")[0].as_py(), part.packed(), shard, shard, np.zeros(len(shard), np.int64), shards)

    return entries.groupBy("key").applyInArrow(pack, _PARTS)


def wished(table: DataFrame, upto: np.ndarray, shards: int, turn: int) -> DataFrame:
    """_PARTS of the next round. A part sends the task of each of its groups how many members it has in which shard, and gets the sums over all parts; a group that all documents have is one entry a part."""
    kinds, names = [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["key", "source", "blob", "now"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob, now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _table(names, kinds, [(to, key, x, None) for to, x in Part.opened(blob).asks(_moved(now, upto), shards)]).to_batches()

    def answer(t: pa.Table) -> pa.Table:
        to = t.column("key")[0].as_py()
        return _table(names, kinds, [(key, to, x, None) for key, x in zip(t.column("source").to_pylist(), answers(t.column("blob").to_pylist(), shards), strict=True)])

    def wish(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in names[1:]), strict=True), key=lambda r: r[0])
        (_, blob, now), replies = rows[0], [_opened(x) for _, x, _ in rows[1:]]
        shard = _moved(now, upto)
        return _part_row(t.column("key")[0].as_py(), blob, shard, *Part.opened(blob).wishes(replies, shard, shards, turn), shards)

    asked = table.select("key", "blob", "now").mapInArrow(ask, _SENT)
    answered = asked.groupBy("key").applyInArrow(answer, _SENT)
    return answered.unionByName(table.select("key", F.lit(-1).alias("source"), "blob", "now")).groupBy("key").applyInArrow(wish, _PARTS)


def placed(table: DataFrame, upto: np.ndarray) -> DataFrame:
    """``number, shard`` of the documents of _PARTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(Part.opened(blob).number), pa.array(_moved(now, upto).astype(np.int32))], ["number", "shard"])

    return table.select("blob", "now").mapInArrow(run, "number long, shard int")


def memberships(groups: DataFrame | None, edges: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """``group, doc_id, weight`` of holders() or of edges, each of which is a group of two; groups have numbers instead of two hashes. And the tables to delete at the end."""
    number = F.monotonically_increasing_id().alias("group")  # written, so that it stays
    if edges is not None:
        pairs = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
        pairs = _scratch.write(pairs.select("*", number), "links")
        return pairs.select("group", F.explode(F.array("a", "b")).alias("doc_id"), "weight"), [pairs]
    rows = _scratch.write(groups, "links")
    names = _scratch.write(rows.select("x", "y").distinct().select("*", number), "groups")
    return rows.join(names, ["x", "y"]).select("group", "doc_id", "weight"), [rows, names]


def numbered(ids: DataFrame) -> DataFrame:
    """``doc_id, number`` from 0, by the ranges of the ids' hash, without a global sort."""
    parts = ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    first = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    at = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("doc_id"))).join(F.broadcast(first), "part")  # 1024 rows at any size
    return at.select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).alias("number"))


def even_start(ids: DataFrame, shards: int) -> DataFrame:
    """``doc_id, shard`` with sizes that differ by at most one."""
    return numbered(ids).select("doc_id", F.pmod("number", F.lit(shards)).cast("int").alias("shard"))


def even_rest(sizes: list[int], n: int) -> list[int]:
    """How many of n documents each shard gets so that the largest of those that get some is as small as can be."""
    low, high = 0, max(sizes) + n
    while low < high:
        level = (low + high) // 2
        low, high = (low, level) if sum(max(level - x, 0) for x in sizes) >= n else (level + 1, high)
    out = [max(low - x, 0) for x in sizes]
    for i in [i for i, x in enumerate(out) if x][: sum(out) - n]:
        out[i] -= 1
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS, edges: DataFrame | None = None) -> DataFrame:
    """``doc_id, shard`` of every distinct id; linked documents gather, sizes stay within ceil((1 + slack) * documents / shards).

    Linked documents start evenly spread. In each round the half of the linked ones
    that its hash chooses may move to the shard with the largest weight of
    neighbours (the lowest number of equal ones) if it beats their own; into
    each shard the largest gains (by powers of two) go first, and no more than its free places.
    Rounds end early when hardly any moves. A table of 16 x 256 counts per shard
    decides who is admitted, so no shard's candidates are sorted on one
    machine. Documents keep to parts of about PART_ROWS memberships, which ask
    for the members of their groups in each shard. edges (a, b, weight) replaces holders(); ends that aren't ids of
    docs are ignored. Very long texts count whole. Documents without links, as of null and empty texts, fill
    the shards up evenly at the end, so their places are free for those that
    gather. Null ids have no row; rows that repeat an id are one document; an
    empty table gives no rows; extra columns are ignored.
    """
    start = _scratch.write(numbered(docs.select(docs[id_col].alias("doc_id")).where("doc_id IS NOT NULL").distinct()), "start")
    total = start.count()
    capacity = -(-total * (1 + slack) // shards)
    member, made = memberships(holders(docs, id_col, text_col) if edges is None else None, edges)
    parts = -(-made[0].count() * max(shards, 16) // (16 * PART_ROWS)) or 1
    entries = member.join(start, "doc_id").select(F.pmod("number", F.lit(parts)).cast("int").alias("key"), "number", F.xxhash64("doc_id").alias("hash"), "group", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    table = _scratch.write(parted(entries, parts, shards), "parts")
    _scratch.drop(*made)

    def wishes() -> DataFrame:
        w = table.select(F.explode(F.arrays_zip("wish", "times")).alias("w"))
        place = F.floor(F.col("w.wish") / shards)
        return w.select((F.col("w.wish") % shards).cast("int").alias("was"), (place % shards).cast("int").alias("to"), F.floor(place / shards).alias("rank"), F.col("w.times").alias("n"))

    sizes = {r["to"]: r["n"] for r in wishes().groupBy("to").agg(F.sum("n").alias("n")).collect()}
    upto = np.full(shards, -1)
    for turn in range(rounds if sizes else 0):
        then = _scratch.write(wished(table, upto, shards, turn), "parts")
        _scratch.drop(table)
        table = then
        # At most shards x 16 x PARTS ranks, whatever the input.
        free = docs.sparkSession.createDataFrame([(s, int(capacity - sizes.get(s, 0))) for s in range(shards)], "to int, free long")
        ranks = wishes().groupBy("to", "rank").agg(F.sum("n").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy("to").orderBy("rank")))
        upto = np.full(shards, -1)
        for r in ranks.join(F.broadcast(free), "to").where("n <= free").groupBy("to").agg(F.max("rank").alias("rank")).collect():
            upto[r["to"]] = r["rank"]
        flows = wishes().where(F.col("rank") <= F.element_at(F.array(*[F.lit(int(x)) for x in upto]), F.col("to") + 1)).groupBy("was", "to").agg(F.sum("n").alias("n")).collect()
        for r in flows:
            sizes[r["was"]] -= r["n"]
            sizes[r["to"]] = sizes.get(r["to"], 0) + r["n"]
        if sum(r["n"] for r in flows) <= STILL * sum(sizes.values()):
            break
    linked = _scratch.write(placed(table, upto), "shards")
    _scratch.drop(table)
    out = _scratch.write(start.join(linked, "number", "left").select("doc_id", "shard"), "sharded")
    _scratch.drop(start, linked)
    rest = even_rest([sizes.get(i, 0) for i in range(shards)], total - sum(sizes.values()))
    ends = np.cumsum(rest)[:-1].tolist()
    filled = numbered(out.where("shard IS NULL").select("doc_id")).select("doc_id", sum([(F.col("number") >= e).cast("int") for e in ends], F.lit(0)).alias("shard"))
    return out.where("shard IS NOT NULL").unionByName(filled)


def cut_weight(pairs: DataFrame, shards_: DataFrame) -> DataFrame:
    """``cut, total``: weight of links between shards and of all links."""
    s = shards_.select("doc_id", "shard")
    x = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("shard").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("shard").alias("sb")), "b")
    return x.agg(F.coalesce(F.sum(F.when(F.col("sa") != F.col("sb"), F.col("weight"))), F.lit(0)).alias("cut"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
