"""How often ids meet in shared ids: sums over pairs without a row for each meeting.

Where a shared id has many members, blocks of ids meet as tiles: a task has the
members of two blocks and adds up the matrix of their pairs, so pairs are never
shuffled and there are no more of them in memory than a tile has cells. Where
shared ids have few members, tiles would copy rows more often than they meet;
then tasks list the meetings of their shared ids as sorted numbers, add up equal
ones and send the gaps between them, packed, to the tasks of their ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.session import checkpointed, small

#: Ids of a block, meetings that are made or gathered at once, and rows of a batch that is given back.
WIDE, AT_ONCE, BATCH = 4096, 1 << 22, 1 << 19
#: Meetings of a shared id in a tile from which it is added by itself instead of with others.
ALONE = 512
SCHEMA = "a long, b long, n double"


def summed_pairs(rows: DataFrame, n: int, ordered: bool = False, weigh: Callable | None = None, part: int = 1024, tiled: bool | None = None, degrees: bool = False) -> DataFrame:
    """``a, b, n`` for pairs of codes below n that meet, from distinct ``s, p`` (and what else follows): a < b and the number of common s.

    ordered takes the place ``k`` of p within s, and a is before b. weigh gives a meeting's
    weight from two dicts of arrays w, t of its members, which is added up instead
    of 1 unless either lacks ``ok``; n is null if all of a pair's do. tiled chooses the way,
    by default that of fewer copies; in lists, ids s of more members than part are split,
    and every two of their parts meet. degrees gives ``code, d`` instead (degrees()).
    """
    fields = ["p", *(["k"] if ordered else []), *(["w", "t", "ok"] if weigh else [])]
    rows = rows.select("s", *fields)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // WIDE), min(int((4 * cores) ** 0.5) + 1, n // 64))
    sizes = checkpointed(rows.groupBy("s").agg(F.count("*").alias("d")).where("d > 1"))
    held, meetings, most = sizes.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)), F.coalesce(F.max("d"), F.lit(0))).first()
    tiled = held * blocks <= max(meetings, 10 * AT_ONCE) if tiled is None else tiled
    if not tiled:
        pairs = _listed(rows, sizes if most > part else None, n, meetings, fields, weigh, part)
        return pairs.select(F.explode(F.array("a", "b")).alias("code")).groupBy("code").agg(F.count("*").alias("d")) if degrees else pairs
    out = _tiled(rows, sizes, n, blocks, fields, weigh, degrees)
    return out.groupBy(F.col("a").alias("code")).agg(F.sum("n").cast("long").alias("d")) if degrees else out


def degrees(rows: DataFrame, n: int) -> DataFrame:
    """``code, d``: with how many others each code meets, from distinct ``s, p``."""
    return summed_pairs(rows, n, degrees=True)


def _crossed(left: np.ndarray, right: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each left index with count indices from right on, at most about AT_ONCE at a time."""
    upto = np.cumsum(count)
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE, side="right")))
        c = count[i:j]
        within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(left[i:j], c), np.repeat(right[i:j], c) + within
        i = j


def _own(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of each group with those after them."""
    left = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    ends = np.repeat(starts + sizes, sizes)
    return _crossed(left, left + 1, ends - left - 1)


def _both(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of groups that start at a with those of their partners that start at b."""
    left = np.repeat(a - (np.cumsum(sizes_a) - sizes_a), sizes_a) + np.arange(sizes_a.sum())
    return _crossed(left, np.repeat(b, sizes_a), np.repeat(sizes_b, sizes_a))


def _members(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Starts and sizes of lists of structs, and the structs' fields."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.cumsum(sizes) - sizes, sizes, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _weights(weigh: Callable, x: dict, y: dict, i: object, j: object) -> tuple[np.ndarray, np.ndarray]:
    """Meetings' weights, 0 where they have none, and where they have none."""
    none = ~(x["ok"][i] & y["ok"][j])
    return np.where(none, 0.0, weigh({c: x[c][i] for c in "wt"}, {c: y[c][j] for c in "wt"})), none


class _Cells:
    """Sums of a tile's cells, one table a direction: meetings, and for weights also their sum and those that have none."""

    def __init__(self, width: int, directions: int, weighted: bool):
        self.n = np.zeros((directions, width, width), np.int32)
        self.w = np.zeros((directions, width, width)) if weighted else None
        self.none = np.zeros((directions, width, width), np.int32) if weighted else None

    def add(self, direction: int, cell: np.ndarray, weight: np.ndarray | None, none: np.ndarray | None) -> None:
        np.add.at(self.n[direction].reshape(-1), cell, 1)
        if weight is not None:
            np.add.at(self.w[direction].reshape(-1), cell, weight)
            np.add.at(self.none[direction].reshape(-1), cell[none], 1)

    def found(self, direction: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """Rows, columns and values of the cells that have any, some at a time."""
        n = self.n[direction]
        step = max(1, BATCH // n.shape[1])
        for first in range(0, n.shape[0], step):
            i, j = np.nonzero(n[first : first + step])
            i += first
            if self.w is None:
                yield i, j, pa.array(n[i, j].astype(float))
            else:
                yield i, j, pa.array(self.w[direction, i, j], mask=n[i, j] == self.none[direction, i, j])


def _tile(x: tuple, y: tuple, same: bool, width: int, ordered: bool, weigh: Callable | None) -> _Cells:
    """The sums of a tile's pairs; a side is its shared ids, starts, sizes and fields."""
    (sx, ax, nx, fx), (sy, ay, ny, fy) = x, y
    cells = _Cells(width, 2 if ordered and not same else 1, weigh is not None)
    _, ix, iy = np.intersect1d(sx, sy, assume_unique=True, return_indices=True)
    met = nx[ix] * ny[iy]
    few, dense = met < ALONE, met > (width * width // 16 if ordered else width * width // 64)
    for i, j in _own(ax[ix[few]], nx[ix[few]]) if same else _both(ax[ix[few]], nx[ix[few]], ay[iy[few]], ny[iy[few]]):
        a, b = fx["p"][i].astype(np.int64), fy["p"][j].astype(np.int64)
        weight, none = _weights(weigh, fx, fy, i, j) if weigh else (None, None)
        before = fx["k"][i] < fy["k"][j] if ordered else a < b
        if same:
            cells.add(0, np.where(before, a * width + b, b * width + a), weight, none)
        elif not ordered:
            cells.add(0, a * width + b, weight, none)
        else:
            for d, on in ((0, before), (1, ~before)):
                cells.add(d, (a * width + b)[on], weight[on] if weigh else None, none[on] if weigh else None)
    if not ordered:
        for g, h in zip(ix[~few & ~dense], iy[~few & ~dense], strict=True):
            cells.n[0][np.ix_(fx["p"][ax[g] : ax[g] + nx[g]], fy["p"][ay[h] : ay[h] + ny[h]])] += 1
        ix, iy = ix[~few & dense], iy[~few & dense]
        for first in range(0, len(ix), 256):
            sides = []
            for which, a, n, f in ((ix, ax, nx, fx), (iy, ay, ny, fy)):
                m = np.zeros((len(which[first : first + 256]), width), np.float32)
                for r, g in enumerate(which[first : first + 256]):
                    m[r, f["p"][a[g] : a[g] + n[g]]] = 1
                sides.append(m)
            cells.n[0] += (sides[0].T @ sides[1]).astype(np.int32)
        if same:
            cells.n[0] = np.triu(cells.n[0], 1)
        return cells
    short, turn = np.zeros((cells.n.shape[0], width, width), np.uint8), 0
    for g, h, wide in zip(ix[~few], iy[~few], dense[~few], strict=True):
        i, j = slice(ax[g], ax[g] + nx[g]), slice(ay[h], ay[h] + ny[h])
        a, b = fx["p"][i], fy["p"][j]
        if weigh is None and not wide:
            square, k, l = np.ix_(a, b), fx["k"][i][:, None], fy["k"][j][None, :]
            cells.n[0][square] += k < l
            if not same:
                cells.n[1][square] += k > l
            continue
        if weigh is None:
            # Absent ids are after all others as first of a pair and before all as second.
            first, second = np.full((2, width), np.iinfo(np.int64).max), np.full((2, width), -1)
            for side, (at, k) in enumerate(((a, fx["k"][i]), (b, fy["k"][j]))):
                first[side, at] = second[side, at] = k
            short[0] += (first[0][:, None] < second[1][None, :]).view(np.uint8)
            if not same:
                short[1] += (second[0][:, None] > first[1][None, :]).view(np.uint8)
            turn += 1
            if turn % 255 == 0:
                cells.n += short
                short[:] = 0
            continue
        for r in range(0, len(a), 256):
            at = slice(i.start + r, min(i.stop, i.start + r + 256))
            weight, none = _weights(weigh, {c: v[:, None] if c in ("w", "t", "ok") else v for c, v in fx.items()}, {c: v[None, :] if c in ("w", "t", "ok") else v for c, v in fy.items()}, at, (slice(None), j))
            before = fx["k"][at][:, None] < fy["k"][j][None, :]
            square = np.ix_(fx["p"][at], b)
            for d, on in ((0, before), (1, fx["k"][at][:, None] > fy["k"][j][None, :]))[: cells.n.shape[0]]:
                cells.n[d][square] += on
                cells.w[d][square] += np.where(on, weight, 0.0)
                if none.any():
                    cells.none[d][square] += none & on
    cells.n += short
    return cells


def _tiled(rows: DataFrame, sizes: DataFrame, n: int, blocks: int, fields: list[str], weigh: Callable | None, degrees: bool) -> DataFrame:
    """summed_pairs() by tiles of two blocks of consecutive codes; or each tile's ids, twice, and their numbers of others there."""
    spark = rows.sparkSession
    width, ordered = max(1, -(-n // blocks)), "k" in fields
    tiles = blocks * (blocks + 1) // 2
    # Shared ids get numbers, since a tile's task matches them.
    keys = checkpointed(sizes.select("s", F.monotonically_increasing_id().alias("key")))
    block = F.floor(F.col("p") / width).cast("int")
    member = F.struct(F.pmod("p", F.lit(width)).cast("short").alias("p"), *[F.col(c) for c in fields[1:]])
    lists = checkpointed(rows.join(small(keys), "s").groupBy("key", block.alias("block")).agg(F.collect_list(member).alias("of")))
    x, y = F.least("block", "other"), F.greatest("block", "other")
    sent = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("key", "block", x.alias("x"), y.alias("y"), "of")
    tasks = min(tiles, 20_000)
    tile = (F.col("x") * blocks - F.col("x") * (F.col("x") - 1) / 2 + F.col("y") - F.col("x")).cast("int")
    parted = sent.repartitionById(tasks, F.pmod(tile, F.lit(tasks))).sortWithinPartitions("x", "y")

    def done(x: int, y: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        own = table["block"].to_numpy()
        sides = []
        for b in dict.fromkeys((x, y)):
            part = table.filter(pa.array(own == b))
            sides.append((part["key"].to_numpy(), *_members(part["of"])))
        if len(sides[0][0]) == 0 or len(sides[-1][0]) == 0:
            return
        cells = _tile(sides[0], sides[-1], x == y, width, ordered, weigh)
        if degrees:
            for first, axis in ((x, 1), (y, 0)):
                found = np.count_nonzero(cells.n[0], axis=axis)
                some = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(some + first * width), pa.array(some), pa.array(found[some].astype(float))], ["a", "b", "n"])
            return
        for d in range(cells.n.shape[0]):
            for i, j, value in cells.found(d):
                ends = (i + x * width, j + y * width)
                yield pa.RecordBatch.from_arrays([pa.array(ends[d]), pa.array(ends[1 - d]), value], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], (-1, -1)
        for batch in batches:
            x, y = batch["x"].to_numpy(), batch["y"].to_numpy()
            edges = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if held and now != (x[i], y[i]):
                    yield from done(*now, held)
                    held = []
                now = (int(x[i]), int(y[i]))
                held.append(batch.slice(i, j - i))
        if held:
            yield from done(*now, held)

    return parted.mapInArrow(run, SCHEMA)


def _packed(codes: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Ascending codes as gaps, and values, all by planes of bytes and compressed."""
    out = []
    for array in (np.diff(codes, prepend=np.int64(0)).astype(np.uint64), *values):
        raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(len(small).to_bytes(4, "little") + small)
    return len(codes).to_bytes(4, "little") + b"".join(out)


def _unpacked(blob: bytes, kinds: list[type]) -> list[np.ndarray]:
    size, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for kind in (np.uint64, *kinds):
        length = int.from_bytes(blob[at : at + 4], "little")
        wide = np.dtype(kind).itemsize
        raw = pa.decompress(blob[at + 4 : at + 4 + length], decompressed_size=size * wide, codec="zstd", asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, size).T).view(kind).reshape(size))
        at += 4 + length
    return [np.cumsum(out[0].astype(np.int64)), *out[1:]]


def _added(codes: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct codes, ascending, and the sums of their values."""
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], [np.add.reduceat(v[order], first, dtype=v.dtype) for v in values]


def _listed(rows: DataFrame, sizes: DataFrame | None, n: int, meetings: float, fields: list[str], weigh: Callable | None, part: int) -> DataFrame:
    """summed_pairs() by lists of meetings; a pair is the number a n + b, and ranges of these are tasks. sizes are given if some s have more members than part."""
    spark = rows.sparkSession
    ordered, base = "k" in fields, max(n, 1)
    # What a list becomes is much more than it is, so their size must not decide on the number of tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, int(meetings // (8 * AT_ONCE)))
    ranges = max(4 * spark.sparkContext.defaultParallelism, int(meetings // (2 * AT_ONCE)))
    kinds = [np.int32] if weigh is None else [np.int32, np.float64, np.int32]
    if sizes is None:
        lists = rows.repartition(tasks, "s").groupBy("s").agg(F.collect_list(F.struct(*fields)).alias("x"))
        sent = lists.select("x", F.slice("x", 1, 0).alias("y"))
    else:
        parts = F.ceil(F.col("d") / part).cast("int")
        split = rows.join(sizes, "s").select("s", parts.alias("parts"), F.pmod(F.xxhash64("p"), parts).cast("int").alias("part"), F.struct(*fields).alias("m"))
        lists = checkpointed(split.groupBy("s", "part", "parts").agg(F.collect_list("m").alias("x")))
        many = lists.where("parts > 1")
        others = many.join(many.select("s", F.col("part").alias("then"), F.col("x").alias("y")), "s").where("part < then").select("x", "y")
        sent = lists.select("x", F.slice("x", 1, 0).alias("y")).unionByName(others).repartition(tasks)

    def flushed(codes: list, values: list) -> Iterator[pa.RecordBatch]:
        if codes:
            found, sums = _added(np.concatenate(codes), [np.concatenate(v) for v in zip(*values, strict=True)])
            # Ends of ranges are even over the codes of a, so a range is at most twice as full as the mean unless ids differ.
            at = np.searchsorted(found, [base * (base * r // ranges) for r in range(ranges + 1)])
            some = np.flatnonzero(np.diff(at))
            blobs = [_packed(found[at[r] : at[r + 1]], [v[at[r] : at[r + 1]] for v in sums]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["range", "blob"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, values, held = [], [], 0
        for batch in batches:
            (ax, nx, fx), (ay, ny, fy) = _members(batch["x"]), _members(batch["y"])
            alone = ny == 0
            for f, pairs in ((fx, _own(ax[alone], nx[alone])), (fy, _both(ax[~alone], nx[~alone], ay[~alone], ny[~alone]))):
                for i, j in pairs:
                    a, b = fx["p"][i], f["p"][j]
                    before = fx["k"][i] < f["k"][j] if ordered else a < b
                    codes.append(np.where(before, a, b) * base + np.where(before, b, a))
                    one = [np.ones(len(i), np.int32)]
                    if weigh:
                        weight, none = _weights(weigh, fx, f, i, j)
                        one += [weight, none.astype(np.int32)]
                    values.append(one)
                    held += len(i)
                    if held >= 2 * AT_ONCE:
                        yield from flushed(codes, values)
                        codes, values, held = [], [], 0
        yield from flushed(codes, values)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, new, size = np.zeros(0, np.int64), [np.zeros(0, k) for k in kinds], [], 0

        def joined() -> tuple[np.ndarray, list[np.ndarray]]:
            return _added(np.concatenate([held, *[x[0] for x in new]]), [np.concatenate([sums[i], *[x[i + 1] for x in new]]) for i in range(len(kinds))])

        for batch in batches:
            for blob in batch["blob"]:
                new.append(_unpacked(blob.as_py(), kinds))
                size += len(new[-1][0])
                if size > max(2 * AT_ONCE, len(held)):
                    held, sums = joined()
                    new, size = [], 0
        if new:
            held, sums = joined()
        for i in range(0, len(held), BATCH):
            part = slice(i, i + BATCH)
            value = pa.array(sums[0][part].astype(float)) if weigh is None else pa.array(sums[1][part], mask=sums[0][part] == sums[2][part])
            yield pa.RecordBatch.from_arrays([pa.array(held[part] // base), pa.array(held[part] % base), value], ["a", "b", "n"])

    return sent.mapInArrow(listed, "range int, blob binary").repartitionById(ranges, "range").mapInArrow(merged, SCHEMA)
