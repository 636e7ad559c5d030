import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from brute import ODD, odd_rows, prose

from netspark.llm import packing, quality_rules


def brute_judge(text: str | None) -> tuple:
    """The rule as written: one frame for the whole text and one for each chunk."""
    if not text:
        return (None if text is None else 0, None, 0, None, None, 0, False, "empty")
    data, b = text.encode(), quality_rules.BANDS
    whole = len(zstandard.compress(data, b.level)) / len(data)
    chunks = []
    while data:
        cut = b.chunk_bytes if len(data) >= b.chunk_bytes + b.least_chunk else len(data)
        if chunks or cut >= b.least_chunk:
            chunks.append(len(zstandard.compress(data[:cut], b.level)) / cut)
        data = data[cut:]
    low, high = next((x, y) for n, x, y in reversed(b.limits) if len(text.encode()) >= n)
    out = len([c for c in chunks if c < b.chunk_low or c > b.chunk_high])
    reason = "repetitive" if whole < low else "incompressible" if whole > high else "chunks" if out / max(1, len(chunks)) > b.chunk_share else None
    return (len(text.encode()), whole, len(chunks), min(chunks) if chunks else None, max(chunks) if chunks else None, out, reason is None, reason)


def test_judgements_against_brute_force():
    """Texts of all lengths around the limits and chunks, repetitive, plain, noisy, and mixed."""
    rng = random.Random(17)
    zip_ = zstandard.ZstdCompressor(level=3)
    seen = set()
    for n in (1, 15, 16, 23, 31, 47, 63, 64, 127, 255, 511, 1023, 1024, 4095, 4096, 4097, 5119, 5120, 9000, 16384, 40_000):
        for text in (prose(rng, n)[:n], ("ab " * n)[:n], "".join(chr(rng.randint(33, 126)) for _ in range(n)), (prose(rng, n)[: n // 2] + "x" * n)[:n], (prose(rng, n)[: 2 * n // 3] + "".join(chr(rng.randint(33, 2000)) for _ in range(n // 3)))[:n]):
            mine = quality_rules.judge(text, quality_rules.BANDS, zip_)
            assert mine == pytest.approx(brute_judge(text))
            seen.add(mine[-1])
    assert seen - {"empty"} == {None, "repetitive", "incompressible", "chunks"}


def test_null_ids_and_repeated_rows_are_judged_by_their_texts(spark):
    rng = random.Random(3)
    good, bad = prose(rng, 200), "buy now " * 300
    df = spark.createDataFrame([(None, good, "a", True), (None, bad, "a", True), (1, good, "a", None), (1, good, "a", None), (1, bad, None, None)], "doc_id long, text string, reason string, keep boolean")
    rows = quality_rules.compression_bands(df).collect()
    assert sorted((r["doc_id"] or 0, r["keep"], r["reason"] or "") for r in rows) == [(0, False, "repetitive"), (0, True, ""), (1, False, "repetitive"), (1, True, ""), (1, True, "")]
    kept = quality_rules.keep_compressible(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["text"] == good) for r in kept.collect()) == [(0, True), (1, True), (1, True)]


def test_bands_reject_what_repeats_and_noise(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randint(33, 126)) for _ in range(5000))
    texts = [prose(rng, 300), "again and " * 400, noise, None, "", "hi", prose(rng, 30_000) + noise * 9, prose(rng, 300)]
    df = spark.createDataFrame(odd_rows(texts), ODD)
    rows = {r["doc_id"]: r for r in quality_rules.compression_bands(df).collect()}
    assert [rows[i]["reason"] for i in range(6)] == [None, "repetitive", "incompressible", "empty", "empty", None]
    assert rows[3]["n_bytes"] is None and rows[4]["n_bytes"] == 0 and rows[7]["keep"]
    for i, t in enumerate(texts):
        assert tuple(rows[i])[1:] == pytest.approx(brute_judge(t))
    kept = quality_rules.keep_compressible(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i in rows if rows[i]["keep"]]
    assert quality_rules.compression_bands(df.limit(0)).count() == 0


def test_a_bad_stretch_fails_by_its_chunks():
    rng = random.Random(2)
    bands = quality_rules.Bands(limits=((0, 0.0, 99.0),))
    zip_ = zstandard.ZstdCompressor(level=3)
    text = prose(rng, 1500) + "x" * 9000
    out = quality_rules.judge(text, bands, zip_)
    assert out[-1] == "chunks" and out[2] == -(-len(text) // 4096) - (len(text) % 4096 < 1024) and out[5] >= 2


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    kept = quality_rules.compression_bands(docs).join(good, "doc_id").agg({"keep": "max"}).count() and quality_rules.compression_bands(docs).join(good, "doc_id").selectExpr("avg(cast(keep as double)) AS share").first()["share"]
    assert kept > 0.97


def brute_windows(blocks: list[list[tuple]], capacity: int, most_open: int, merge: int) -> list[tuple]:
    """Every window as (merged, pieces), by the rule as written, with plain lists; blocks hold (id, tokens)."""

    def fill(w: list) -> int:
        return sum(p[2] for p in w)

    out, left = [], {}
    for b, rows in enumerate(blocks):
        open_ = []
        for doc, n in sorted(rows):
            for start in range(0, n, capacity):
                size = min(capacity, n - start)
                room = [w for w in open_ if fill(w) + size <= capacity]
                if room:
                    w = max(room, key=fill)
                    w.append((doc, start, size))
                else:
                    if size < capacity and len(open_) == most_open:
                        full = max(open_, key=fill)
                        open_.remove(full)
                        out.append((False, full))
                    w = [(doc, start, size)]
                    open_.append(w)
                if fill(w) == capacity:
                    open_ = [x for x in open_ if x is not w]
                    out.append((False, w))
        left[b] = open_
    while left and any(left.values()):
        last, groups = max(left) < merge, {}
        for b, windows in left.items():
            groups.setdefault(b // merge, []).extend(windows)
        left = {}
        for b, windows in groups.items():
            merged = []
            for w in sorted(windows, key=lambda w: (-fill(w), w[0])):
                room = [m for m in merged if fill(m) + fill(w) <= capacity]
                if room:
                    max(room, key=fill).extend(w)
                else:
                    merged.append(list(w))
            merged.sort(key=lambda w: (fill(w), w[0]))
            left[b] = [] if last else merged[:most_open]
            out += [(True, w) for w in (merged if last else merged[most_open:])]
        left = {b: w for b, w in left.items() if w}
    return sorted((m, tuple(w)) for m, w in out)


def blocks_of(spark, sizes: list[tuple], kind: str, block: int) -> list[list[tuple]]:
    """The blocks of numbered(): rows by their hash range, then in order, cut into runs of block."""
    df = spark.createDataFrame(sizes, f"doc_id {kind}, n long").selectExpr("doc_id", "n", f"pmod(xxhash64(doc_id, n), {packing.RANGES}) AS r")
    order = [(i, n) for _, i, n in sorted((r["r"], r["doc_id"], r["n"]) for r in df.collect())]
    return [order[i : i + block] for i in range(0, len(order), block)]


def pieces(rows: list) -> list[tuple]:
    return sorted((r["merged"], tuple(zip(r["doc_ids"], r["starts"], r["lengths"], strict=True))) for r in rows)


@pytest.mark.parametrize(("kind", "merge"), [("long", 3), ("string", 3), ("long", 20)])
def test_packing_against_brute_force(spark, kind, merge):
    """Also ids that repeat, far apart and as strings, and leftovers of several levels."""
    rng = random.Random(5)
    ids = [str(i * 10**9) if kind == "string" else i * 10**9 for i in [*range(390), *[7] * 90, *range(20)]]
    texts = [" ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 13, 40, 100, 250])) for _ in ids]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(5)
    rows = packing.pack(df, capacity=64, most_open=4, block=40, merge=merge).collect()
    assert pieces(rows) == brute_windows(blocks_of(spark, [(i, len(t.split())) for i, t in zip(ids, texts, strict=True)], kind, 40), 64, 4, merge)
    assert all(r["n_tokens"] == sum(r["lengths"]) <= 64 and r["n_docs"] == len(set(r["doc_ids"])) for r in rows)
    assert len({r["window_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("name", ["doc_id", "doc_id * 1000003 AS doc_id", "concat('d', doc_id) AS doc_id"])
def test_windows_are_full_whatever_the_ids(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr(name, "text")
    fill = packing.pack(docs).agg({"n_tokens": "avg"}).first()[0] / packing.CAPACITY
    assert fill > 0.95


def test_packing_odd_rows(spark):
    texts = ["a b c", None, "", " \n ", "a b c", "x " * 5000]
    df = spark.createDataFrame([*odd_rows(texts), odd_rows(texts)[0], (1, None, "lost", *["x"] * 3, 1, *["y"] * 5)], ODD)
    rows = packing.pack(df).collect()
    assert sum(r["n_tokens"] for r in rows) == 3 + 3 + 3 + 5000
    assert {d for r in rows for d in r["doc_ids"]} == {0, 4, 5}
    assert packing.pack(df.limit(0)).count() == 0


def test_token_counts():
    texts = ["Hello, world_1!", "", "çé  x", "a-b", "\t\n"]
    assert packing.count_tokens(pa.array(texts, pa.large_string())).tolist() == [4, 0, 2, 3, 0]
    assert packing.count_tokens(pa.array([], pa.large_string())).tolist() == np.zeros(0).tolist()
