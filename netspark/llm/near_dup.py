"""SimHash near-duplicate search with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netspark.llm import _scratch
from netspark.llm._graph import components
from netspark.llm._tokens import U, Splitter, chunks, mix, string_column

#: Bits of a signature, and of a segment of the ring.
BITS, SEGMENT = 256, 8
SEGMENTS = BITS // SEGMENT
MAX_DISTANCE = 36
CHAIN = 8
#: Segments at the begin of a chain whose differences key_masks() lists.
KEYED = 3
#: Signatures that one task compares; a cell of more is split by the bits of its chains' first segment, and then into blocks of which every two meet.
CELL = 1_000_000
#: Bits of the first segment that are a key at most; there are fewer for few signatures, so that FULL or more share a key.
KEY_BITS, FULL = 14, 16
#: Words of a text that are counted in one number for each bit of the count, and blocks of them that one byte can count.
BLOCK, RUN = 16, 15
#: Pairs that are looked at at once: a table of their differing bits stays in the cache.
PAIRS = 1 << 16
#: Bits that Sliced compares, members that it holds at most, words that it works on at once, and members and pairs from which on it pays.
SLICED, MEMBERS, WORDS, FEW, PAYS = 24, 1024, 1 << 14, 32, 1 << 17
#: Members of a bucket from which on those that are connected are looked at as a whole, and rows that are tried for that.
LARGE, TRIED = 64, 8


def _lanes() -> np.ndarray:
    """For each byte, its bits as the bytes of a 64-bit number."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(U).ravel()


LANES = _lanes()
#: Bit k of 0, 1, .. 15, as a whole number of such bits.
NIBBLE = -(np.arange(16) >> np.arange(4)[:, None] & 1)[:, :, None].astype(U)


def tallies(bits: np.ndarray) -> list[np.ndarray]:
    """For numbers in blocks of BLOCK (the last axis), how many have each bit: bits 0, 1, .. 4 of these counts as numbers of the same bits."""
    planes = [np.ascontiguousarray(np.moveaxis(bits, -1, 0))]
    while len(planes[0]) > 1:
        sums, carried = [], None
        for x in planes:
            a, b = x[: len(x) // 2], x[len(x) // 2 :]
            one, both = a ^ b, a & b
            if carried is not None:
                both |= one & carried
                one ^= carried
            sums.append(one)
            carried = both
        planes = [*sums, carried]
    return [x[0] for x in planes]


def simhash(column: pa.Array, splitter: Splitter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x 4, int64) of the sets of words, and the numbers of distinct words.

    A bit is set if it is set in the hashes of more than half of the words.
    """
    splitter = splitter or Splitter()
    signatures, sizes = np.zeros((len(column), 4), np.int64), np.zeros(len(column), np.int64)
    for a, b in chunks(column):
        words = splitter.words(column.slice(a, b - a))
        if not len(words.hash):
            continue
        for c in range(0, b - a, 1 << 18):  # rows have 18 bits in a key
            d = min(c + (1 << 18), b - a)
            i, j = words.first[c], words.first[d]
            if i == j:
                continue
            key = np.sort(((words.row[i:j] - c).astype(U) << U(46)) | (words.hash[i:j] >> U(18)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            row = (key >> U(46)).astype(np.int64)
            word = mix(key & U((1 << 46) - 1))
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            length = np.diff(np.append(begin, len(row)))
            # The words of a row fill blocks of BLOCK, the last of them up with words without a bit.
            blocks = -(-length // BLOCK)
            first = np.cumsum(blocks) - blocks
            place = np.arange(len(word)) + np.repeat(first * BLOCK - begin, length)
            counts = np.zeros((len(begin), BITS), np.int32)
            # A byte of a lane holds up to 255, so rows are cut into runs of at most 15 blocks.
            number = -(-blocks // RUN)
            owner = np.repeat(np.arange(len(begin)), number)
            runs = np.repeat(first - RUN * (np.cumsum(number) - number), number) + RUN * np.arange(len(owner))
            for k in range(0, len(runs), 256):
                part = runs[k : k + 256]
                lo, hi = part[0], runs[k + 256] if k + 256 < len(runs) else first[-1] + blocks[-1]
                x, y = np.searchsorted(place, [lo * BLOCK, hi * BLOCK])
                bits = np.zeros((4, BLOCK * (hi - lo)), U)
                for s in range(4):
                    bits[s, place[x:y] - lo * BLOCK] = mix(word[x:y] + U((s + 1) * 0x9E3779B97F4A7C15 % 2**64))
                lanes = np.zeros((hi - lo, 32), U)
                for weight, ones in enumerate(tallies(bits.reshape(4, hi - lo, BLOCK))):
                    lanes += LANES.take(np.ascontiguousarray(ones.T).view(np.uint8)) << U(weight)
                sums = np.add.reduceat(lanes, part - lo, axis=0).view(np.uint8).reshape(len(part), BITS)
                of = owner[k : k + 256]
                new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                counts[of[new]] += np.add.reduceat(sums, new, axis=0, dtype=np.int32)
            at = row[begin]
            sizes[a + c + at] = length
            signatures[a + c + at] = np.packbits(2 * counts > length[:, None], axis=1).view(np.int64)
    return signatures, sizes


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, s0..s3, n`` of every row with an id and at least one word."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(f"s{i}", T.LongType()) for i in range(4)], T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            s, n = simhash(string_column(batch.column(1)), splitter)
            out = pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(s[:, i].copy()) for i in range(4)], pa.array(n)], ["id", "s0", "s1", "s2", "s3", "n"])
            yield out.filter(pa.array(n > 0))

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def budgets(most: int, chain: int = CHAIN, segments: int = SEGMENTS) -> list[int]:
    """Differences that the first l segments of a chain may have, l = 1.. chain."""
    return [length * most // segments for length in range(1, chain + 1)]


def key_masks(most: int, keyed: int = KEYED, segment: int = SEGMENT, segments: int = SEGMENTS) -> np.ndarray:
    """Differences of two keys, of the first keyed segments (of so many bits) of a chain, that stay within the budgets; 0 first, then by their number of bits."""
    masks = np.zeros(1, np.int64)
    one = np.arange(1 << segment)
    for limit in budgets(most, keyed, segments):
        masks = ((masks[:, None] << segment) | one).ravel()
        masks = masks[np.bitwise_count(masks) <= limit]
    return masks[np.lexsort((masks, np.bitwise_count(masks)))]


def viable(x: np.ndarray, chain: int, most: int) -> np.ndarray:
    """Pigeonring: which rows of differing bits (rows x 4, unsigned) have a segment that begins a chain whose differences add up to at most l * most / SEGMENTS after each l <= chain segments. Every pair within the distance has such a chain, whatever its length."""
    d = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8)).astype(np.int32)
    begins, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int32)
    for length, limit in enumerate(budgets(most, chain), 1):
        total += np.roll(d, 1 - length, axis=1)
        begins &= total <= limit
    return begins.any(axis=1)


def bucket_links(s: np.ndarray, most: int, chain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a spanning forest over the signatures (rows x 4, unsigned) of one bucket: both ends and their distance.

    A search visits signatures in order and compares each with those not yet
    reached, so that a bucket of near copies costs little more than its size,
    and what is connected by pairs within the distance comes out connected.
    """
    left, ends, others, distances = np.arange(len(s)), [], [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            d = np.bitwise_count(s[left] ^ s[u]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(d <= most)
            if len(near):
                found = left[near]
                ends.append(np.full(len(found), u))
                others.append(found)
                distances.append(d[near])
                queue += found.tolist()[::-1]
                left = np.delete(left, near)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (ends, others, distances))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    up = parent[x]
    while not np.array_equal(up, again := parent[up]):
        up = again
    return up


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. of size[0] numbers, then the same of the next."""
    return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)


def ring(most: int) -> list[int]:
    """First bits of the ring's segments, and BITS: as few segments as there can be so that one that begins a chain has one difference at most."""
    n = most // 2 + 1
    return [BITS * i // n for i in range(n + 1)]


def rotated(s: np.ndarray, bits: int) -> np.ndarray:
    """Signatures (rows x 4, unsigned; the first number holds the first bits, its lowest the very first) turned so that they begin at another bit."""
    s = np.roll(s, -(bits // 64), axis=1)
    return (s >> U(bits % 64)) | (np.roll(s, -1, axis=1) << U(64 - bits % 64)) if bits % 64 else s


class Sliced:
    """Members of a bucket, of which it tells which differ from a word in few of SLICED bits after the lowest skip.

    A number of 64 bits holds one bit of a count for each of 64 members, so
    counts are added for 64 pairs at a time. Those of each byte are looked up,
    with 7 for 8; that makes a pair too many of limits from 7 on, never one too few.
    """

    def __init__(self, word: np.ndarray, skip: int):
        self.skip, n = skip, len(word)
        self.width = w = -(-n // 64)
        bits = np.zeros((SLICED, 64 * w), np.uint8)
        bits[:, :n] = word >> np.arange(skip, skip + SLICED, dtype=U)[:, None] & U(1)
        own = np.packbits(bits, axis=1, bitorder="little").view(U).reshape(-1, 4, 1, w)
        # Of each 4 bits, the counts (at most 4) of those that differ from 0, 1, .. 15.
        a, b, c, d = (own[:, k] ^ NIBBLE[k] for k in range(4))
        ab, cd, two, more = a ^ b, c ^ d, a & b, c & d
        counts = [ab ^ cd, two ^ more ^ (ab & cd), two & more]
        low, high = [x[::2].reshape(-1, 1, 16 * w) for x in counts], [np.tile(x[1::2, :, None], (1, 1, 16, 1)).reshape(-1, 16, 16 * w) for x in counts]
        *sums, eight = self.plus(low, high)
        self.counts = [[x.reshape(256, w) for x in of] for of in zip(*(x | eight for x in sums), strict=True)]
        self.real = np.packbits(np.arange(64 * w) < n, bitorder="little").view(U)

    @staticmethod
    def plus(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        """Bits of the sums of numbers of three bits, and what is carried."""
        out, carried = [], None
        for x, y in zip(a, b, strict=True):
            one, both = x ^ y, x & y
            if carried is None:
                out.append(one)
                carried = both
            else:
                out.append(one ^ carried)
                one &= carried
                both |= one
                carried = both
        return [*out, carried]

    def near(self, word: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Members and words (some WORDS // width) of the pairs with at most limit differences."""
        (*sums,), *others = [[x.take((word >> U(self.skip + 8 * byte) & U(255)).astype(np.intp), axis=0, mode="clip") for x in counts] for byte, counts in enumerate(self.counts)]
        for more in others:
            *three, carried = self.plus(sums[:3], more)
            sums = [*three, *([carried] if len(sums) == 3 else [sums[3] ^ carried, sums[3] & carried])]
        above = None  # whether the lower bits are above those of limit
        for k, x in enumerate(sums):
            if above is None:
                above = None if limit >> k & 1 else x
            else:
                above = above & x if limit >> k & 1 else above | x
        found = (~above & self.real).ravel()
        at = np.flatnonzero(found != 0)
        pair = np.flatnonzero(np.unpackbits(found[at].view(np.uint8), bitorder="little").view(bool))
        at = at[pair >> 6]
        row = at // self.width
        return (at - row * self.width) * 64 + (pair & 63), row


class Forest:
    """Signatures of one cell, rotated so that their chains begin at the first bit, and the links found so far.

    A bucket has one key: the lowest bits of the first segment, of which a
    chain's begin may differ in one. Members of two such buckets are compared
    all with all: many by SLICED bits of the next segments, and what is left of
    them by their first 64 bits, which belong to the first segments of
    the chain and so have a budget that hardly any pair of different texts
    stays within. The cell's own signatures have group as the lowest bits of
    their key; it has others only to compare its own with.
    """

    def __init__(self, s: np.ndarray, most: int, width: int, group: int = 0, bits: int = 0):
        starts = ring(most)
        self.most, self.segments = most, len(starts) - 1
        self.skip = min(width, 64 - SLICED)
        self.limit, self.sliced = (budgets(most, min(self.segments, -(-n // int(np.diff(starts).min()))), self.segments)[-1] for n in (64, self.skip + SLICED))
        self.width = max(bits, min(width, (len(s) // FULL).bit_length() - 1, KEY_BITS), 0)
        key = (s[:, 0] & U((1 << self.width) - 1)).astype(np.uint16)
        self.order = np.argsort(key, kind="stable")
        self.s, key = s[self.order], key[self.order].astype(np.int64)
        self.word, self.parent = np.ascontiguousarray(self.s[:, 0]), np.arange(len(s))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.key, self.first, self.size = key[begin], begin, np.diff(np.append(begin, len(s)))
        self.own = np.flatnonzero(self.key & ((1 << bits) - 1) == group)
        self.ends: list[tuple[int, int, int]] = []
        self.differing, self.counts = np.empty(PAIRS, U), np.empty(PAIRS, np.uint8)

    def join(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        """Keep those of the links that connect what nothing did."""
        n = len(self.parent)
        ra, rb = _roots(self.parent, a), _roots(self.parent, b)
        _, some = np.unique(np.minimum(ra, rb) * n + np.maximum(ra, rb), return_index=True)
        parent = self.parent
        for x, y, i in zip(ra[some].tolist(), rb[some].tolist(), some.tolist(), strict=True):
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.ends.append((int(a[i]), int(b[i]), int(d[i])))
        parent[a], parent[b] = _roots(parent, a), _roots(parent, b)

    def check(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs of members within the distance that aren't connected yet."""
        new = _roots(self.parent, a) != _roots(self.parent, b)
        a, b = a[new], b[new]
        d = np.bitwise_count(self.s[a] ^ self.s[b]).sum(axis=1, dtype=np.int64)
        near = d <= self.most
        if near.any():
            self.join(a[near], b[near], d[near])

    def compare(self, a: np.ndarray, b: np.ndarray, spent: int = 0) -> None:
        """Look for links between all of members a and all of b, whose keys differ in spent bits, some PAIRS at a time or 64 pairs in one number."""
        x, y = self.word[a], self.word[b]
        if len(a) >= FEW and len(a) * len(b) >= PAYS:
            for i in range(0, len(a), MEMBERS):
                held = Sliced(x[i : i + MEMBERS], self.skip)
                for j in range(0, len(b), step := WORDS // held.width):
                    u, v = held.near(y[j : j + step], self.sliced - spent)
                    u, v = u + i, v + j
                    few = np.bitwise_count(x[u] ^ y[v]) <= self.limit
                    if few.any():
                        self.check(a[u[few]], b[v[few]])
            return
        across = max(1, min(len(b), PAIRS))
        down = PAIRS // across
        for i in range(0, len(a), down):
            for j in range(0, len(b), across):
                u, v = x[i : i + down], y[j : j + across]
                n = len(u) * len(v)
                np.bitwise_xor.outer(u, v, out=self.differing[:n].reshape(len(u), len(v)))
                few = np.flatnonzero(np.bitwise_count(self.differing[:n], out=self.counts[:n]) <= self.limit)
                if len(few):
                    self.check(a[i + few // len(v)], b[j + few % len(v)])

    def same_key(self, first: int, size: int) -> None:
        """Links within a bucket. One that is mostly near copies is searched so that they cost little more than their number."""
        members = np.arange(first, first + size)
        s = self.s[first : first + size]
        if size > LARGE:
            tried = s[:: -(-size // TRIED)]
            # Most buckets have so few that are alike in the first word that the others needn't be read.
            alike = (np.bitwise_count(np.bitwise_xor.outer(tried[:, 0], self.word[first : first + size])) <= self.most // 2).sum(axis=1)
            if alike.max() > size // TRIED and max((np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64) <= self.most).sum() for t in tried) > size // TRIED:
                a, b, d = bucket_links(s, self.most, CHAIN)
                if len(a):
                    self.join(a + first, b + first, d)
                return
        for i in range(0, size, MEMBERS):
            self.compare(members[i : i + MEMBERS], members[i:])

    def other_key(self, members: np.ndarray, others: np.ndarray) -> None:
        """Links between a bucket and its neighbours; many members that are connected aren't compared with what they are connected with."""
        if len(members) > LARGE:
            root = _roots(self.parent, members)
            roots, n = np.unique(root, return_counts=True)
            for r in roots[n > LARGE].tolist():
                same, step = members[root == r], TRIED
                while len(same) and len(others):
                    now = _roots(self.parent, others) != _roots(self.parent, same[:1])
                    self.compare(same[:step], others[now], 1)
                    same, step = same[step:], PAIRS // LARGE
            members = members[np.isin(root, roots[n > LARGE], invert=True)]
        if len(members):
            self.compare(members, others, 1)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both ends and distances of a spanning forest of all pairs of the cell whose chain begins at their first segment."""
        few = self.own[(self.size[self.own] > 1) & (self.size[self.own] <= FULL)]
        for n in np.unique(self.size[few]).tolist():
            i, j = np.triu_indices(n, 1)
            begin = self.first[few[self.size[few] == n]]
            for k in range(0, len(begin), max(1, PAIRS // len(i))):
                part = begin[k : k + max(1, PAIRS // len(i)), None]
                a, b = (part + i).ravel(), (part + j).ravel()
                near = np.bitwise_count(self.word[a] ^ self.word[b]) <= self.limit
                self.check(a[near], b[near])
        for i in self.own[self.size[self.own] > FULL].tolist():
            self.same_key(int(self.first[i]), int(self.size[i]))
        masks = key_masks(self.most, 1, self.width, self.segments)[1:]
        place = np.full(1 << self.width, -1)
        place[self.key] = np.arange(len(self.key))
        for i in self.own.tolist():
            key = self.key[i]
            near = place[key | masks[key & masks == 0]]  # of two keys that differ so, the one without the bit
            near = near[near >= 0]
            if len(near):
                self.other_key(np.arange(self.first[i], self.first[i] + self.size[i]), _ranges(self.first[near], self.size[near]))
        a, b, d = (np.array(x, np.int64) for x in zip(*self.ends, strict=True)) if self.ends else (np.zeros(0, np.int64),) * 3
        return self.order[a], self.order[b], d


def group_bits(n: int, cell: int, most: int) -> int:
    """Lowest bits of a chain's first segment by which n signatures are told apart so that a cell has about cell of them, with those of its neighbours."""
    most_bits = min(KEY_BITS, int(np.diff(ring(most)).min()))
    return next((bits for bits in range(most_bits) if n * (2 + bits) <= cell << (bits + 1)), most_bits)


def _cells(own: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``group, rows`` for the groups of rows: a row's own group, and the lower ones that differ in one bit, since the first segment may."""
    out = [(own, np.arange(len(own)))]
    for bit in range(bits):
        some = np.flatnonzero(own & (1 << bit))
        out.append((own[some] ^ (1 << bit), some))
    return out


def similar_links(distinct: DataFrame, most: int = MAX_DISTANCE, cell: int = CELL) -> DataFrame:
    """``a, b, distance``: links between ids whose signatures (id, s0..s3; one row each) differ in at most most bits, as many as connect what all such pairs connect.

    Complete for most up to 63: by the pigeonring principle some segment of
    every such pair begins a chain within its budgets. Each signature goes to
    one cell for every segment of ring(), where Forest compares it with all
    whose first segments differ in a bit at most. Beyond cell
    signatures a cell is split by bits of the first segment (of which the
    budget may spend one, so cells get signatures of their neighbours), and if one is
    still larger, as of a text with very many copies, into blocks, a task for
    every two. The result is the same for any size of cell.
    """
    if most // SEGMENTS > 1:
        raise ValueError(f"max_distance is {2 * SEGMENTS - 1} at most")
    id_type = distinct.schema["id"].dataType
    kind = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("distance", T.IntegerType())])
    starts = ring(most)
    bits = group_bits(distinct.count(), cell, most)
    parts: dict[tuple[int, int], int] = {}
    if bits:
        # At most len(starts) - 1 rows for each of the 2 ** bits groups, as many as there are cells.
        words = [F.shiftrightunsigned(f"s{k // 64}", k % 64) if k % 64 + bits <= 64 else F.shiftrightunsigned(f"s{k // 64}", k % 64).bitwiseOR(F.shiftleft(f"s{k // 64 + 1}", 64 - k % 64)) for k in starts[:-1]]
        counts = distinct.select(F.posexplode(F.array(*[w.bitwiseAND(F.lit((1 << bits) - 1)) for w in words])).alias("place", "first")).groupBy("place", "first").count().collect()
        for r in counts:
            for group, rows in _cells(np.array([r["first"]]), bits):
                if len(rows):
                    parts[r["place"], int(group[0])] = parts.get((r["place"], int(group[0])), 0) + r["count"]
    blocks = {k: -(-n // cell) for k, n in parts.items() if n > cell}
    names = ["place", "cell", "i", "j"]
    sent = T.StructType([*[T.StructField(c, T.IntegerType()) for c in names], T.StructField("ids", T.ArrayType(id_type)), T.StructField("s", T.BinaryType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            s = np.stack([batch.column(f"s{i}").to_numpy() for i in range(4)], axis=1).view(U)
            own = mix(np.ascontiguousarray(s[:, 0]))
            keys, takes, blobs = [], [], []
            for place, start in enumerate(starts[:-1]):
                turned = rotated(s, start)
                for group, rows in _cells((turned[:, 0] & U((1 << bits) - 1)).astype(np.int64), bits):
                    order = np.argsort(group, kind="stable")
                    group, rows = group[order], rows[order]
                    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))[: len(group)]
                    for g, at in zip(group[begin].tolist(), np.split(rows, begin[1:]), strict=False):
                        n = blocks.get((place, g), 1)
                        block = (own[at] % U(n)).astype(np.int64)
                        for i, j in [(i, j) for i in range(n) for j in range(i + 1, n)] or [(0, 0)]:
                            both = at if n == 1 else at[(block == i) | (block == j)]
                            if len(both):
                                keys.append((place, g, i, j))
                                takes.append(both)
                                blobs.append(turned[both].tobytes())
            ids = batch.column("id").take(pa.array(np.concatenate(takes)))
            offsets = np.cumsum([0, *map(len, takes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in zip(*keys, strict=True)], pa.ListArray.from_arrays(offsets, ids), pa.array(blobs, pa.binary())], sent.names)

    def links(key: tuple[int, int, int, int], ids: list[pa.Array], blobs: list[bytes]) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        place, group, _, _ = key
        a, b, d = Forest(np.frombuffer(b"".join(blobs), U).reshape(-1, 4), most, starts[place + 1] - starts[place], group, bits).links()
        return pa.RecordBatch.from_arrays([own.take(pa.array(a)), own.take(pa.array(b)), pa.array(d.astype(np.int32))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, blobs = None, [], []
        for batch in batches:
            lists, s = batch.column("ids"), batch.column("s")
            for r, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if key != now:
                    if ids:
                        yield links(now, ids, blobs)
                    now, ids, blobs = key, [], []
                ids.append(lists[r].values.cast(kind))
                blobs.append(s[r].as_py())
        if ids:
            yield links(now, ids, blobs)

    rows = distinct.select("id", "s0", "s1", "s2", "s3").mapInArrow(send, sent)
    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, keep_id, group_size``: a row for each document that duplicates another one.

    Documents are linked if the 256-bit SimHashes of their sets of words differ
    in at most max_distance bits; groups are what links connect, keep_id is the
    least id of a group and has no row itself. Equal signatures are one entry
    of the search, so thousands of copies cost no more than two. Null ids and
    texts and texts without a word have no signature and are never grouped;
    rows that repeat an id count as one document, also with different texts.
    An empty table gives none. Extra columns are ignored. Every pair within
    max_distance takes part in the groups (similar_links()), however large
    a group is and however long the texts are.
    """
    table = _scratch.write(signatures(docs, id_col, text_col), "signatures")
    same = Window.partitionBy("s0", "s1", "s2", "s3")
    members = _scratch.write(table.select("id", "s0", "s1", "s2", "s3").select("*", F.min("id").over(same).alias("rep")), "members")
    distinct = members.where("id = rep").select("id", "s0", "s1", "s2", "s3").distinct()
    edges = similar_links(distinct, max_distance).select("a", "b").unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    groups = components(edges)
    _scratch.drop(table, members)
    size = F.count("*").over(Window.partitionBy("component"))
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("keep_id"), size.alias("group_size")).where("doc_id <> keep_id")


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group of near duplicates: that of the least id.

    Every other row stays as it is, also those with null id or text; rows that
    repeat an id share its fate.
    """
    return _scratch.without_ids(docs, _scratch.write(near_duplicates(docs, max_distance=max_distance).select("doc_id"), "dropped"))
