"""Quality rules: compression bands by zstandard."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T



@dataclass(frozen=True)
class Bands:
    """Limits of compressed to raw size, by length in UTF-8 bytes.

    limits has (least length, low, high) in ascending order: what compresses to
    less than low repeats itself, what stays above high is noise. Short frames
    carry a header, so their high limits exceed 1, and under 16 bytes they are
    all header. Chunks of chunk_bytes (a last one under least_chunk bytes belongs to
    the one before it; a text of fewer bytes has none) have their own band, and a
    document fails if more than chunk_share of its chunks lie outside.
    """

    limits: tuple[tuple[int, float, float], ...] = ((0, 0.0, 99.0), (16, 0.9, 1.9), (24, 0.8, 1.6), (32, 0.6, 1.45), (48, 0.5, 1.35), (64, 0.4, 1.3), (128, 0.35, 1.15), (256, 0.32, 0.98), (512, 0.3, 0.9), (1024, 0.28, 0.84), (4096, 0.25, 0.82), (16384, 0.2, 0.8))
    chunk_bytes: int = 4096
    least_chunk: int = 1024
    chunk_low: float = 0.2
    chunk_high: float = 0.84
    chunk_share: float = 0.25
    level: int = 3


#: Limits for production.
BANDS = Bands()
COLUMNS = "n_bytes long, ratio double, n_chunks long, chunk_min double, chunk_max double, chunks_out long, keep boolean, reason string"


def judge(text: str | None, bands: Bands, zip_: zstandard.ZstdCompressor) -> tuple:
    """The columns of COLUMNS for one text."""
    if not text:
        return 0 if text == "" else None, None, 0, None, None, 0, False, "empty"
    data = text.encode("utf-8", "surrogatepass")
    n, size = len(data), bands.chunk_bytes
    ratio = len(zip_.compress(data)) / n
    if n <= size:
        chunks = [ratio] if n >= bands.least_chunk else []
    else:
        view = memoryview(data)
        ends = [*range(size, n, size), n]
        if n - ends[-2] < min(bands.least_chunk, size):
            del ends[-2]
        parts = [view[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        chunks = [len(zip_.compress(p)) / len(p) for p in parts]
    _, low, high = bands.limits[bisect_right(bands.limits, (n, float("inf"))) - 1]
    out = sum(not bands.chunk_low <= c <= bands.chunk_high for c in chunks)
    reason = None
    if ratio < low:
        reason = "repetitive"
    elif ratio > high:
        reason = "incompressible"
    elif out > bands.chunk_share * len(chunks):
        reason = "chunks"
    return n, ratio, len(chunks), min(chunks, default=None), max(chunks, default=None), out, reason is None, reason


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = BANDS) -> DataFrame:
    """Each document's compression ratios, whether it stays, and if not, why.

    One narrow pass, no shuffle: ``doc_id`` and COLUMNS, a row for each row of
    docs. ``reason`` is ``repetitive`` or ``incompressible`` for the whole text,
    ``chunks`` if too many fixed chunks lie outside their band, ``empty`` for
    null (n_bytes null) and empty texts, which are rejected; null if it stays.
    Null ids pass through, repeated rows are judged alike, very long texts are
    judged whole, a value on a limit is inside, an empty table gives no rows,
    extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        types = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
        for batch in batches:
            rows = [judge(x.as_py(), bands, zip_) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def keep_compressible(docs: DataFrame, bands: Bands = BANDS) -> DataFrame:
    """Rows of docs that compression_bands() keeps, all their columns as they were, in one narrow pass without a join.

    Null and empty texts go; null ids and repeated rows are kept or not by
    their texts alone; of an empty table comes an empty one. docs must have a
    column ``text``; others of any name pass through.
    """
    at = docs.columns.index("text")
    plain = docs if docs.schema[at].dataType == T.StringType() else docs.withColumn("text", docs["text"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([judge(x.as_py(), bands, zip_)[6] for x in batch.column(at)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema)


__all__ = ["BANDS", "Bands", "compression_bands", "judge", "keep_compressible"]
