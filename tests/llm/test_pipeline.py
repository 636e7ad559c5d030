"""run() of the corpus pipeline against a plain version of all five stages."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import zstandard
from brute import contained, edited, near_groups, prose
from test_rules_and_packing import blocks_of, brute_windows, pieces

from netspark.llm import decontaminate, near_dup, packing, quality_rules, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(spark, docs: list[tuple[int, str | None]], items: list[str]) -> list[tuple]:
    zip_ = zstandard.ZstdCompressor(level=3)
    docs = [d for d in docs if quality_rules.judge(d[1], quality_rules.BANDS, zip_)[6]]
    root, _ = near_groups([t for _, t in docs], near_dup.MAX_DISTANCE)
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    docs = [(i, t) for i, t in docs if not any(contained(t, x, decontaminate.SHINGLE)[0] >= decontaminate.THRESHOLD for x in items)]
    net = secret_scan.network()
    out = []
    for i, t in docs:
        column = pa.array([t], pa.large_string())
        for _, text, spans in secret_scan.find_candidates(column):
            for a, b in reversed(spans):
                if text.startswith("-----BEGIN", a) or net.probability(secret_scan.encode(text, a, b)).max() >= net.threshold:
                    t = t[:a] + secret_scan.MASK + t[b:]
        out.append((i, int(packing.count_tokens(pa.array([t], pa.large_string()))[0])))
    return brute_windows(blocks_of(spark, [x for x in out if x[1]], "long", packing.BLOCK), packing.CAPACITY, packing.OPEN, packing.MERGE)


def test_run(spark, tmp_path):
    rng = random.Random(11)
    items = [prose(rng, 40) for _ in range(5)]
    texts: list[str | None] = []
    for i in range(120):
        t = prose(rng, rng.choice([8, 60, 200, 900]))
        if i % 9 == 0:
            t += " " + rng.choice(items)
        if i % 7 == 0:
            t += ' api_key = "ghp_' + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(36)) + '"'
        texts.append(t)
    texts += [edited(rng, texts[i], 0.01) for i in range(1, 30) if len(texts[i].split()) >= 60] + [texts[3], texts[3], None, "", "again " * 500, "w " * 9000]
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mine = pieces(out)
    assert mine == plain(spark, rows, items) and len(mine) > 10


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_document_is_packed_or_rejected_once(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [d for r in out for d in set(r["doc_ids"])]
    known = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert set(ids) <= known and np.all([r["n_tokens"] <= packing.CAPACITY for r in out])
    pieces_ = sorted(p for r in out for p in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True))
    for (a, start, n), (b, then, _) in zip(pieces_, pieces_[1:], strict=False):  # every token once: pieces of a document follow each other
        assert then == (start + n if a == b else 0)


def test_odd_documents(spark, tmp_path):
    """Null ids, repeated rows and ids, ties of copies, a very long text, and columns whose names the stages use."""
    rng = random.Random(31)
    a, b, long_ = prose(rng, 120), prose(rng, 120), prose(rng, 50_000)
    rows = [(3, a), (1, a), (1, a), (2, b), (2, b + " more"), (None, b), (None, None), (5, long_), (6, None), (7, "")]
    columns = ", ".join(f"{c} string" for c in ("id", "key", "s0", "block", "place", "own"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 6) for i, t in rows], f"{SCHEMA}, {columns}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for r in out:
        for i, n in zip(r["doc_ids"], r["lengths"], strict=True):
            tokens[i] = tokens.get(i, 0) + n
    count = lambda t: int(packing.count_tokens(pa.array([t], pa.large_string()))[0])
    assert tokens == {1: 2 * count(a), 2: 2 * count(b) + 1, 5: count(long_)}


def test_the_near_duplicate_stage_hardly_looks_at_texts_that_are_not(monkeypatch):
    """Texts of one vocabulary, whose signatures are nearer to each other than random ones."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(4000)]
    s = near_dup.simhash(pa.array(texts, pa.large_string()))[0].view(np.uint64)
    far, check = [], near_dup.Forest.check

    def looked(self, a, b):
        far.append(int(np.sum(np.bitwise_count(self.s[a] ^ self.s[b]).sum(axis=1) > near_dup.MAX_DISTANCE)))
        return check(self, a, b)

    monkeypatch.setattr(near_dup.Forest, "check", looked)
    for place in range(0, 32, 4):
        near_dup.Forest(np.roll(s.view(np.uint8), -place, axis=1).copy().view(np.uint64), near_dup.MAX_DISTANCE, 8).links()
    assert sum(far) < len(texts) // 10
