"""HTML extraction: boilerplate found by a suffix array over each host's pages."""

from __future__ import annotations

import html as entities
import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netspark.llm import _scratch
from netspark.llm._tokens import Splitter, U, Words, chunks, raw, shingles, string_column
from netspark.llm.url_filter import host

#: Tokens (a power of two) from which a repeated substring is boilerplate, pages on which it must occur, and shortest run that is kept.
LEAST, PAGES, RUN = 8, 2, 1
#: Bytes of HTML whose token streams make one suffix array on one machine; a host of more has several, which exchange what repeats between them.
BLOCK_BYTES = 24 << 20
_TOKEN = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def visible(html: Column) -> Column:
    """Text of a page with entities still escaped: comments, scripts, styles and tags go, block tags end lines."""
    gone = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)|<!doctype[^>]*>", " ")
    lines = F.regexp_replace(gone, r"(?i)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|article|section|header|footer|main|aside|table|tr|td|th|title|head|body|html|blockquote|pre|form)\b[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"<[A-Za-z/!?][^>]*>", " "), r"[ \t\r\f]*+\n\s*+", "\n")


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = LEAST, pages: int = PAGES) -> np.ndarray:
    """Which tokens lie in a substring of at least least tokens that occurs on at least so many distinct pages.

    tokens are any numbers, page the ascending number of each token's page. The
    suffix array is built by prefix doubling and ordered by the first least tokens of
    each suffix: a longer repeat is the union of its stretches of least
    tokens, each of which is on the same pages at least, so what further
    doubling would order changes nothing that is covered.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    if n < least:
        return np.zeros(n, bool)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    rank += 1
    length = 1
    while length < least:
        following = np.zeros(n, np.int64)  # 0: the suffix ends with its page before
        following[:-length] = np.where(page[:-length] == page[length:], rank[length:], 0)
        following += rank * (n + 1)
        order = np.argsort(following, kind="stable")
        key = following[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank[order] = np.cumsum(new)
        del key, new, following
        length *= 2
    whole = np.zeros(n, bool)
    whole[: n - least + 1] = page[: n - least + 1] == page[least - 1 :]
    suffixes = order[whole[order]]
    group = rank[suffixes]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    other = np.zeros(len(suffixes), np.int64)
    other[1:] = page[suffixes[1:]] != page[suffixes[:-1]]
    other[begin] = 1
    often = np.add.reduceat(other, begin) >= pages if len(begin) else np.zeros(0, bool)
    at = suffixes[np.repeat(often, np.diff(np.append(begin, len(suffixes))))]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + least, -1)
    return np.cumsum(covered)[:n] > 0


def prefixes(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first least tokens of all suffixes that are so long within their page, and where they begin."""
    return shingles(Words(tokens, page, tokens, tokens, tokens), least)


class Stream:
    """Pages of one host: their bytes, and their tokens in order."""

    def __init__(self) -> None:
        self.texts: list[pa.Array] = []
        self.hash: list[np.ndarray] = []
        self.page: list[np.ndarray] = []
        self.span: list[np.ndarray] = []
        self.pages = 0

    def add(self, texts: pa.Array, splitter: Splitter) -> None:
        for a, b in chunks(texts):
            part = texts.slice(a, b - a)
            data, offsets = raw(part)
            words = splitter.words_of(data, offsets, _TOKEN)
            self.hash.append(words.hash)
            self.page.append((words.row + self.pages).astype(np.int32))
            self.span.append(np.stack([words.start, words.end], axis=1).astype(np.int32))
            self.texts.append(part)
            self.pages += b - a

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and page of every token."""
        return np.concatenate([np.zeros(0, U), *self.hash]), np.concatenate([np.zeros(0, np.int32), *self.page])

    def extract(self, shared: bool, least: int, pages: int, run: int, elsewhere: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each chunk of pages their remaining text, tokens, and remaining tokens. Unless the pages share a host, all remains. elsewhere tells which of the block's distinct prefixes, in order, repeat with other blocks of the host; it is empty if there are none."""
        token, page = self.tokens()
        covered = repeated(token, page, least, pages) if shared else np.zeros(len(token), bool)
        if len(elsewhere):
            key, begin = prefixes(token, page, least)
            begin = begin[elsewhere[np.unique(key, return_inverse=True)[1]]]
            more = np.zeros(len(token) + 1, np.int64)
            np.add.at(more, begin, 1)
            np.add.at(more, begin + least, -1)
            covered |= np.cumsum(more)[:-1] > 0
        at = first = 0
        for part, own, span in zip(self.texts, self.page, self.span, strict=True):
            data = raw(part)[0]
            gone = covered[at : at + len(own)]
            at += len(own)
            row = own - first
            first += len(part)
            edge = np.ones(len(own) + 1, bool)
            if len(own):
                edge[1:-1] = (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])
            cut = np.flatnonzero(edge)
            texts: list[list[str]] = [[] for _ in range(len(part))]
            kept = np.zeros(len(part), np.int64)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if not gone[i] and (j - i >= run or not shared):
                    texts[row[i]].append(data[span[i, 0] : span[j - 1, 1]].tobytes().decode("utf-8"))
                    kept[row[i]] += j - i
            yield ["\n".join(t) for t in texts], np.bincount(row, minlength=len(part)) if len(own) else kept.copy(), kept


#: A block's pages, or the prefixes that it learns of, in some of its rows.
BLOCK = "host string, block long, blocks long, blob binary"


#: Parts into which copies are spread on their way to the result.
SPREAD = 4096


def _least(ids: Iterable) -> Any:
    """The least id; null comes last."""
    return min(ids, key=lambda i: (i is None, i if i is not None else 0))


def _token_count(text: str, splitter: Splitter) -> int:
    return int(splitter.words_of(*raw(string_column(pa.array([text], pa.large_string()))), _TOKEN).first[-1])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a block in a batch as one compressed row: what hosts repeat is shuffled small.

    A page's block is given by its text, so equal texts of a host meet. Of those in a
    batch only the one of the least id goes there, so that even a text of very
    many pages is few in its block; the others are copies already and go elsewhere.
    """
    zip_, splitter = zstandard.ZstdCompressor(level=3), Splitter()
    for batch in batches:
        equal: dict[tuple, dict[Any, int]] = {}
        groups: dict[tuple, list[tuple]] = {}
        copies: dict[str, list[tuple]] = {}
        for i, name, blocks, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text if text is None or "&" not in text else entities.unescape(text)
            if text and name:
                own = equal.setdefault((name, blocks, text), {})
                own[i] = own.get(i, 0) + 1
            else:
                key = (name, xxhash.xxh64_intdigest(str(i)) % blocks, blocks)
                groups.setdefault(key, []).append((i, text, 1))
        for (name, blocks, text), own in equal.items():
            first = _least(own)
            groups.setdefault((name, xxhash.xxh64_intdigest(text) % blocks, blocks), []).append((first, text, own.pop(first)))
            if own:
                n = _token_count(text, splitter)
                copies.setdefault(name, []).extend((i, n, times) for i, times in own.items())
        keys, blobs = list(groups), [("pages", *zip(*rows, strict=True)) for rows in groups.values()]
        for name, rows in copies.items():
            keys.append(("", xxhash.xxh64_intdigest(str(rows[0][0])) % SPREAD, 1))
            blobs.append(("copies", name, *zip(*rows, strict=True)))
        yield _rows(keys, [zip_.compress(pickle.dumps(b)) for b in blobs])


def _rows(keys: list[tuple], blobs: list[bytes]) -> pa.RecordBatch:
    columns = list(zip(*keys, strict=True)) if keys else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(blobs, pa.binary())], ["host", "block", "blocks", "blob"])


def _together(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by)


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, int, list[Any]]]:
    """Groups of rows that follow each other: their key, their number of blocks, and their opened blobs."""
    unzip = zstandard.ZstdDecompressor()
    now, blocks, blobs = None, 0, []
    for batch in batches:
        for *key, n, blob in zip(*(batch.column(c).to_pylist() for c in (*by, "blocks", "blob")), strict=True):
            if tuple(key) != now:
                if blobs:
                    yield now, blocks, blobs
                now, blobs = tuple(key), []
            blocks = n
            blobs.append(pickle.loads(unzip.decompress(blob)))
    if blobs:
        yield now, blocks, blobs


class Block:
    """Pages of a block: their stream, each text of a host once, the rows of each, copies, and which distinct prefixes repeat in other blocks."""

    def __init__(self, blobs: list[Any], shared: bool):
        self.texts: dict[Any, dict[Any, int]] = {}
        self.copies: list[tuple] = []
        told = []
        for what, *rest in blobs:
            if what == "told":
                told.append(rest)
            elif what == "copies":
                self.copies += [(rest[0], *row) for row in zip(*rest[1:], strict=True)]
            else:
                for i, text, times in zip(*rest, strict=True):
                    own = self.texts.setdefault(text if shared and text else (len(self.texts), text), {})
                    own[i] = own.get(i, 0) + times
        self.ids = [self.texts[t] for t in self.texts]
        plain = [t[1] if isinstance(t, tuple) else t for t in self.texts]
        self.null = np.array([t is None for t in plain], bool)
        self.stream, splitter = Stream(), Splitter()
        self.stream.add(string_column(pa.array(plain, pa.large_string())), splitter)
        self.elsewhere = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, n, bits in sorted(told)]])
        del self.texts

    def rows(self, name: str, *rule: Any) -> Iterator[list[tuple]]:
        """page_id, host, text, n_tokens, n_kept of all rows."""
        yield [(i, host_, "", n, 0) for host_, i, n, times in self.copies for _ in range(times)]
        at = 0
        for texts, n, kept in self.stream.extract(name != "", *rule, self.elsewhere):
            out = []
            for k, (text, a, b) in enumerate(zip(texts, n.tolist(), kept.tolist(), strict=True)):
                own = self.ids[at + k]
                first = _least(own)
                text = None if self.null[at + k] else text
                out += [(i, name or None, *((text, a, b) if i == first else ("", a, 0))) for i, times in own.items() for _ in range(times)]
            at += len(texts)
            yield out


def _encoded(keys: np.ndarray) -> bytes:
    """Sorted keys as planes of the bytes of their differences, of which the high ones compress to nothing."""
    return np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _decoded(planes: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def between_blocks(sent: DataFrame, least: int, on_pages: int) -> DataFrame:
    """Rows of BLOCK with the prefixes that on_pages pages of a host have, but not as many of the block.

    Blocks hold distinct pages, so a prefix's pages add up over blocks. Each
    block sends its distinct prefixes once, in as many ranges as the host has
    blocks, so that a range is no larger than a block; it is told one bit for each.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for (name, block), blocks, blobs in _groups(batches, "host", "block"):
            stream = Block(blobs, True).stream
            key, at = prefixes(*stream.tokens(), least)
            if not len(key):
                continue
            page = stream.tokens()[1][at]
            order = np.lexsort((page, key))
            key, page = key[order], page[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            begin = np.flatnonzero(first)
            pages = np.add.reduceat((first | np.concatenate([[True], page[1:] != page[:-1]])).astype(np.int64), begin)
            key, pages = key[begin], np.minimum(pages, on_pages)
            width = U(2**64 // blocks + 1)
            cuts = np.searchsorted(key // width, np.arange(blocks + 1))
            some = [r for r in range(blocks) if cuts[r + 1] > cuts[r]]
            yield _rows([(name, r, blocks) for r in some], [zip_.compress(pickle.dumps((block, _encoded(key[cuts[r] : cuts[r + 1]]), pages[cuts[r] : cuts[r + 1]].astype(np.uint16).tobytes()))) for r in some])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for (name, place), blocks, blobs in _groups(batches, "host", "block"):
            keys = [_decoded(k) for _, k, _ in blobs]
            key, own = np.concatenate(keys), np.concatenate([np.frombuffer(n, np.uint16) for *_, n in blobs]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.repeat(np.add.reduceat(own, begin), np.diff(np.append(begin, len(key))))
            new = np.empty(len(key), bool)
            new[order] = (total >= on_pages) & (own < on_pages)
            parts = np.split(new, np.cumsum([len(k) for k in keys])[:-1])
            yield _rows([(name, b, blocks) for b, *_ in blobs], [zip_.compress(pickle.dumps(("told", place, len(x), np.packbits(x).tobytes()))) for x in parts])

    asked = _together(sent, "host", "block").mapInArrow(send, BLOCK)
    return _together(asked, "host", "block").mapInArrow(answer, BLOCK)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, on_pages: int = PAGES, run: int = RUN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``page_id, host, text, n_tokens, n_kept`` of every row of pages.

    Tokens are what white space separates in the visible text. A host's pages
    go to one suffix array; tokens in a substring of
    at least least tokens that on_pages distinct pages have are boilerplate,
    and what remains in runs of at least run tokens is the text, a line a run.
    Pages of a host whose visible text is equal are one page of the suffix array, that of the least id; the
    others are copies and keep no text. Hosts of more than block_bytes of HTML are split into blocks by the texts'
    hashes; what repeats between blocks is found by between_blocks(), so the
    result is the same for any size of block. Pages of no host (also null URLs)
    keep all their text. Null HTML gives null text and 0 tokens; null ids are
    pages like others, the last of equal ones; a very long page is as any other and never cut;
    rows that repeat id and text count as one page and are returned each;
    an empty table gives no rows; extra columns are ignored.
    """
    if least & (least - 1) or least < 2:
        raise ValueError("least must be a power of two, 2 at least")
    id_type = pages.schema[id_col].dataType
    html = pages[html_col].cast("string")
    named = pages.select(pages[id_col].alias("page_id"), F.coalesce(host(pages[url_col].cast("string")), F.lit("")).alias("host"), html.alias("html"))
    large = _scratch.write(named.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")).where(F.col("size") > block_bytes).select("host", F.ceil(F.col("size") / F.lit(block_bytes)).alias("blocks")), "hosts")
    placed = named.join(_scratch.hinted(large), "host", "left").select("page_id", "host", F.coalesce("blocks", F.lit(1)).alias("blocks"), visible(F.col("html")).alias("text"))
    sent = placed.mapInArrow(_packed, BLOCK)
    if not large.where("host <> ''").isEmpty():
        sent = sent.unionByName(between_blocks(placed.where("blocks > 1 AND host <> ''").mapInArrow(_packed, BLOCK).where("host <> ''"), least, on_pages))
    schema = T.StructType([T.StructField("page_id", id_type), T.StructField("host", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_kept", T.LongType())])
    kinds = [to_arrow_type(id_type), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), _, blobs in _groups(batches, "host", "block"):
            for rows in Block(blobs, name != "").rows(name, least, on_pages, run):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    return _together(sent, "host", "block").mapInArrow(work, schema)
