"""Benchmark decontamination: a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm import _scratch
from netspark.llm._tokens import U, Splitter, chunks, shingles, signed, string_column

#: Words of a shingle, and the share of an item's distinct shingles that a window must hold.
SHINGLE, THRESHOLD = 4, 0.6
#: Up to so many shingles of the benchmark are sent to the tasks that read documents; beyond, documents' shingles are joined by shuffling.
SENT_SHINGLES = 2_000_000


def _shingled(df: DataFrame, id_col: str, text_col: str, k: int, wanted: np.ndarray | None = None) -> DataFrame:
    """``id, pos, shingle, n_words`` of all shingles, or of those in wanted (sorted)."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("pos", T.LongType()), T.StructField("shingle", T.LongType()), T.StructField("n_words", T.LongType())])
    sent = None if wanted is None else df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        find = None if sent is None else sent.value
        if find is not None:
            near = np.zeros(1 << 20, bool)
            near[(find >> U(44)).astype(np.int64)] = True
        for batch in batches:
            column = string_column(batch.column(1))
            for a, b in chunks(column):
                words = splitter.words(column.slice(a, b - a))
                x, at = shingles(words, k)
                if find is not None and len(find):
                    some = np.flatnonzero(near[(x >> U(44)).astype(np.int64)])
                    slot = np.minimum(np.searchsorted(find, x[some]), len(find) - 1)
                    some = some[find[slot] == x[some]]
                    x, at = x[some], at[some]
                elif find is not None:
                    x, at = x[:0], at[:0]
                row = words.row[at]
                n = np.diff(words.first)[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + row)), pa.array(at - words.first[row]), pa.array(signed(x)), pa.array(n)], schema.names)

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def _best_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of hits in order, the most distinct shingles within span of a hit, and the first such hit, negated: two pointers pass each hit once."""
    for batch in batches:
        most, first = [], []
        for span, pos, shingle in zip(batch.column("span").to_pylist(), batch.column("pos").to_pylist(), batch.column("shingle").to_pylist(), strict=True):
            count: dict[int, int] = {}
            best, at, end = 0, 0, 0
            for i, p in enumerate(pos):
                while end < len(pos) and pos[end] <= p + span:
                    count[shingle[end]] = count.get(shingle[end], 0) + 1
                    end += 1
                if len(count) > best:
                    best, at = len(count), p
                if count[shingle[i]] == 1:
                    del count[shingle[i]]
                else:
                    count[shingle[i]] -= 1
            most.append(best)
            first.append(-at)
        window = pa.StructArray.from_arrays([pa.array(most, pa.int64()), pa.array(first, pa.int64())], ["n", "before"])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "item_id", "size", "need")], window], ["doc_id", "item_id", "size", "need", "best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, sent: int = SENT_SHINGLES) -> DataFrame:
    """Pairs ``doc_id, item_id`` of which some window of the document, as long as the item, holds at least threshold of the item's distinct k-word shingles.

    Also ``containment``, the largest share over the windows, ``window_start``,
    the first word of the first window that reaches it (windows begin at
    shingles of the item), and ``item_shingles``. Case, punctuation and white
    space don't matter. Only an item's rarest shingles over all documents are
    joined, as many as a match cannot avoid; the rest is fetched where one of
    them occurs, within an item's length of it, and where enough shingles are
    there at all. Null ids and texts and items of fewer than k words match
    nothing; rows that repeat an id count as one document if their texts are
    equal and as one that holds the shingles of all of them at their places if
    not; empty tables give no pairs; extra columns are ignored.
    """
    items = _scratch.write(_shingled(benchmark, item_col, item_text_col, k).groupBy(F.col("id").alias("item_id"), "shingle").agg(F.max("n_words").alias("n_words")), "items")
    unique = items.select("shingle").distinct()
    if _scratch.fits(unique, sent):
        table = unique.toArrow()["shingle"].to_numpy().view(U)
        hits = _shingled(docs, id_col, text_col, k, np.sort(table))
    else:
        hits = _shingled(docs, id_col, text_col, k).join(unique, "shingle", "left_semi")
    hits = _scratch.write(hits.select(F.col("id").alias("doc_id"), "pos", "shingle").distinct(), "hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    size = F.count("*").over(Window.partitionBy("item_id"))
    need = F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9))
    ranked = items.join(rarity, "shingle", "left").select("item_id", "shingle", (F.col("n_words") - k).alias("span"), size.alias("size"), F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "shingle")).alias("rank")).withColumn("need", F.greatest(need, F.lit(1)))
    ranked = _scratch.write(ranked.withColumn("prefix", F.col("rank") <= F.col("size") - F.col("need") + 1), "ranked")
    _scratch.drop(items)
    anchors = hits.join(_scratch.hinted(ranked.where("prefix")), "shingle").select("doc_id", "item_id", F.col("pos").alias("anchor"), "span", "size", "need")
    # Anchors within two spans of the one before make one stretch: hits between its ends, a span either way, can share a window with it.
    order = Window.partitionBy("doc_id", "item_id").orderBy("anchor")
    new = F.coalesce(F.col("anchor") - F.lag("anchor").over(order) > 2 * F.col("span"), F.lit(True))
    stretches = anchors.withColumn("stretch", F.sum(new.cast("long")).over(order)).groupBy("doc_id", "item_id", "stretch").agg(F.min("anchor").alias("lo"), F.max("anchor").alias("hi"), F.first("span").alias("span"), F.first("size").alias("size"), F.first("need").alias("need"))
    mine = hits.join(_scratch.hinted(ranked.select("item_id", "shingle")), "shingle")
    near = stretches.join(mine, ["doc_id", "item_id"]).where((F.col("pos") >= F.col("lo") - F.col("span")) & (F.col("pos") <= F.col("hi") + F.col("span")))
    found = near.groupBy("doc_id", "item_id", "stretch").agg(F.first("span").alias("span"), F.first("size").alias("size"), F.first("need").alias("need"), F.count_distinct("shingle").alias("there"), F.sort_array(F.collect_list(F.struct("pos", "shingle"))).alias("hits")).where("there >= need")
    best = found.select("doc_id", "item_id", "span", "size", "need", "hits.pos", "hits.shingle").mapInArrow(_best_window, T.StructType([*[found.schema[c] for c in ("doc_id", "item_id", "size", "need")], T.StructField("best", T.StructType([T.StructField("n", T.LongType()), T.StructField("before", T.LongType())]))])).where("best.n >= need")
    top = best.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.first("size").alias("size"))
    return top.select("doc_id", "item_id", (F.col("best.n") / F.col("size")).alias("containment"), (-F.col("best.before")).alias("window_start"), F.col("size").alias("item_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that contaminated() finds; rows with a null id or text stay."""
    return _scratch.without_ids(docs, _scratch.write(contaminated(docs, benchmark, threshold=threshold).select("doc_id").distinct(), "leaks"))


def oracle_sql(k: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of contaminated(): every window of every pair with a common shingle."""
    grams = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))".format(n=k)
    words = "regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS w"
    return f"""
WITH i AS (SELECT item_id, len(w) AS n_words, unnest({grams}) AS sh FROM (SELECT item_id, {words} FROM benchmark)),
items AS (SELECT DISTINCT item_id, n_words, sh FROM i),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY 1),
d AS (SELECT doc_id, unnest({grams}) AS sh, unnest(range(0, len(w) - {k} + 1)) AS pos FROM (SELECT doc_id, {words} FROM documents) WHERE len(w) >= {k}),
hits AS (SELECT DISTINCT doc_id, item_id, n_words, pos, sh FROM d JOIN items USING (sh)),
w AS (SELECT a.doc_id, a.item_id, a.pos, count(DISTINCT b.sh) AS n FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + a.n_words - {k} GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(n) AS n, arg_min(pos, (-n, pos)) AS window_start FROM w GROUP BY ALL)
SELECT doc_id, item_id, n / size AS containment, window_start, size AS item_shingles
FROM best JOIN sizes USING (item_id) WHERE n >= greatest(1, ceil(size * {threshold} - 1e-9))
"""
