import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from brute import ODD, edited, odd_rows, prose, words

from netspark.llm import sharding
from netspark.llm._tokens import Splitter, U, shingles


def test_winnowing_against_brute_force():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 3, 4, 5, 30]
    x, row = rng.integers(0, 50, sum(sizes)).astype(U), np.repeat(np.arange(len(sizes)), sizes)
    a, b = sharding.winnowed(x, row, 4)
    want, at = set(), 0
    for r, n in enumerate(sizes):
        own = x[at : at + n].tolist()
        at += n
        want |= {(r, min(own[i : i + 4])) for i in range(n - 3)} if n >= 4 else {(r, v) for v in own}
    assert set(zip(b.tolist(), a.tolist(), strict=True)) == want


def test_a_common_passage_links_wherever_it_stands(spark):
    rng = random.Random(2)
    passage = prose(rng, sharding.SHINGLE + sharding.WINDOW - 1)
    texts = [f"{prose(rng, rng.randint(0, 200))} {passage} {prose(rng, rng.randint(0, 200))}" for _ in range(20)] + [prose(rng, 200) for _ in range(20)]
    rows = sharding.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {(r["a"], r["b"]) for r in rows}  # some also by what their windows at the passage's ends share
    assert {(i, i + 1) for i in range(19)} <= found and all(b < 20 for _, b in found)


def test_links_against_brute_force(spark):
    """Short and very short texts, copies, edits and common passages: pairs and weights from plain sets of winnowed shingles."""
    rng = random.Random(13)
    long_ = [prose(rng, rng.choice([45, 80, 300])) for _ in range(12)]
    texts = [*long_, *(edited(rng, t, 0.02) for t in long_), *[prose(rng, n) for n in (1, 2, 7, 8, 20, 38, 39)] * 2, *(edited(rng, prose(random.Random(i), 30), 0.05) for i in (1, 1, 1, 2)), "One two", "two one", "ONE, two!", None, ""]
    column = pa.array([t or "" for t in texts], pa.large_string())
    w = Splitter().words(column)
    shingle = dict(zip(shingles(w, sharding.SHINGLE)[1].tolist(), shingles(w, sharding.SHINGLE)[0].tolist(), strict=True))
    held = []
    for i, t in enumerate(texts):
        own = [shingle[p] for p in range(w.first[i], w.first[i + 1]) if p in shingle]
        few = words(t or "")
        held.append({min(own[k : k + sharding.WINDOW]) for k in range(len(own) - sharding.WINDOW + 1)} if len(own) >= sharding.WINDOW else set(own) if own else {tuple(few)} if few else set())
    want = {(i, j): len(held[i] & held[j]) for j in range(len(texts)) for i in range(j) if held[i] & held[j]}
    rows = sharding.links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {(r["a"], r["b"]): r["weight"] for r in rows} == want and len(want) > 20


def brute_shards(spark, ids: list[int], start: dict[int, int], pairs: dict[tuple[int, int], int], shards: int) -> dict[int, int]:
    """The rounds as written, with plain dictionaries, and the rest filled in evenly; only the hashes are the engine's."""
    near: dict[int, dict[int, int]] = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    at = {i: start[i] for i in ids if i in near}
    capacity = -(-len(ids) * (1 + sharding.SLACK) // shards)
    for turn in range(sharding.ROUNDS):
        hashes = {r["i"]: r["h"] for r in spark.createDataFrame([(i,) for i in at], "i long").selectExpr("i", f"xxhash64(i, {turn}) AS h").collect()}
        wishes: dict[tuple, list[int]] = {}
        for i in at:
            into = [0] * shards
            for j, w in near[i].items():
                into[at[j]] += w
            best = into.index(max(into))
            gain = into[best] - into[at[i]]
            if gain > 0 and hashes[i] % 2 == 0:
                wishes.setdefault((best, sharding.MOST_GAIN - min(gain.bit_length() - 1, sharding.MOST_GAIN), (hashes[i] >> 1) % sharding.PARTS), []).append(i)
        free = [capacity - list(at.values()).count(s) for s in range(shards)]
        upto, moves = [0] * shards, {}
        for (to, _, _), some in sorted(wishes.items()):
            upto[to] += len(some)
            if upto[to] <= free[to]:
                moves |= dict.fromkeys(some, to)
        at |= moves
        if len(moves) <= sharding.STILL * len(at):
            break
    return at


def test_rounds_against_brute_force(spark):
    rng = random.Random(23)
    ids = list(range(300))
    pairs = {}
    for _ in range(500):
        g = rng.randrange(25)
        a, b = sorted(rng.sample(range(g * 10, g * 10 + 10), 2))
        pairs[a, b] = rng.choice([1, 1, 2, 5, 40])
    docs = spark.createDataFrame([(i, None) for i in ids], "doc_id long, text string")
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight long")
    out = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=6, edges=edges).collect()}
    start = {r["doc_id"]: r["shard"] for r in sharding.even_start(docs.select("doc_id"), 6).collect()}
    want = brute_shards(spark, ids, start, pairs, 6)
    assert {i: out[i] for i in want} == want and sorted(out) == ids
    size = [list(out.values()).count(s) for s in range(6)]
    assert max(size) <= np.ceil(1.05 * 300 / 6)


def test_shards_are_even_and_linked_documents_gather(spark):
    rng = random.Random(5)
    edges = [(g * 10 + i, g * 10 + j, 1) for g in range(80) for i in range(10) for j in range(i) if rng.random() < 0.6]
    docs = spark.createDataFrame([(i, None) for i in range(800)], "doc_id long, text string")
    e = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges] + [(5000, 1, 1), (3, 3, 9)], "a long, b long, weight long")
    out = sharding.shard(docs, shards=8, edges=e)
    rows = out.collect()
    size = np.bincount([r["shard"] for r in rows], minlength=8)
    assert sorted(r["doc_id"] for r in rows) == list(range(800)) and size.max() <= np.ceil(1.05 * 800 / 8)
    inside = e.where("a < 800 and a <> b")
    cut, total = sharding.cut_weight(inside, out).first()
    start = sharding.even_start(docs.select("doc_id"), 8)
    assert cut < 0.7 * sharding.cut_weight(inside, start).first()[0] and total == len(edges)


def test_sharding_odd_rows(spark):
    t = prose(random.Random(7), 100)
    texts = [t, None, "", t, "few words", t + " x" * 30_000]
    df = spark.createDataFrame([*odd_rows(texts), odd_rows(texts)[0], (1, None, t, *["x"] * 3, 1, *["y"] * 5)], ODD)
    rows = sharding.shard(df, shards=2).collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2, 3, 4, 5]
    assert sorted(np.bincount([r["shard"] for r in rows], minlength=2))[1] <= 4
    assert sharding.shard(df.limit(0)).count() == 0


def test_copy_groups_gather_by_all_their_pairs(spark):
    rng = random.Random(11)
    sizes = [10, 50, 1000]
    texts = [t for n in sizes for t in [prose(rng, 60)] * n] + [None] * 17_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.shard(docs)
    at = {r["doc_id"]: r["shard"] for r in out.collect()}
    assert max(np.bincount(list(at.values()))) <= np.ceil(1.05 * len(texts) / sharding.SHARDS)
    first = 0
    for n in sizes:
        assert max(np.bincount([at[i] for i in range(first, first + n)])) >= 0.95 * n
        group = docs.where(f"doc_id >= {first} AND doc_id < {first + n}")
        pairs = sharding.links(group)
        assert pairs.count() == n * (n - 1) // 2
        cut, total = sharding.cut_weight(pairs, out).first()
        assert cut <= 0.1 * total
        first += n


def test_the_rest_fills_shards_evenly():
    rng = random.Random(3)
    for _ in range(200):
        sizes, n = [rng.randint(0, 20) for _ in range(rng.randint(1, 8))], rng.randint(0, 60)
        want = list(sizes)
        for _ in range(n):
            want[want.index(min(want))] += 1
        out = sharding.even_rest(sizes, n)
        assert sum(out) == n and min(out) >= 0 and sorted(a + b for a, b in zip(sizes, out, strict=True)) == sorted(want)


def shuffled(spark) -> int:
    """Bytes that all stages of the session have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum({(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}.values())


def test_a_round_is_hashed_as_by_spark(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 12345]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("xxhash64(i) AS h", *[f"xxhash64(i, {t}) AS t{t}" for t in (0, 1, 19)]).collect()
    for t in (0, 1, 19):
        assert sharding.turned(np.array([r["h"] for r in rows]), t).tolist() == [r[f"t{t}"] for r in rows]


def test_rounds_over_many_parts_against_brute_force(spark, monkeypatch):
    """Groups and their documents lie in many parts, and one group is of most documents."""
    monkeypatch.setattr(sharding, "PART_ROWS", 60)
    rng = random.Random(31)
    common, long_ = prose(rng, 45), [prose(rng, 60) for _ in range(25)]
    texts = [f"{edited(rng, rng.choice(long_), 0.02)} {common if rng.random() < 0.6 else prose(rng, 45)}" for _ in range(240)] + ["few words"] * 9 + [None] * 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {(r["a"], r["b"]): r["weight"] for r in sharding.links(docs).collect()}
    start = {r["doc_id"]: r["shard"] for r in sharding.even_start(docs.select("doc_id"), 6).collect()}
    want = brute_shards(spark, list(range(len(texts))), start, pairs, 6)
    parts, at = [], sharding.parted
    monkeypatch.setattr(sharding, "parted", lambda entries, n, shards: parts.append(n) or at(entries, n, shards))
    out = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=6).collect()}
    assert parts[0] > 5 and len(want) > 200 and {i: out[i] for i in want} == want and sorted(out) == list(range(len(texts)))
    assert any(want[i] != start[i] for i in want)


def test_rounds_shuffle_little_and_leave_only_the_result(spark):
    """Members aren't shuffled as rows in every round, and shingles once; joins that a small table would spare by broadcasts are shuffled here, as those of a large one."""
    rng = random.Random(37)
    base = [prose(rng, 120) for _ in range(150)]
    docs = spark.createDataFrame([(i, edited(rng, base[i % 150], 0.01)) for i in range(1500)], "doc_id long, text string").repartition(4).cache()
    rows = sharding.holders(docs).count()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = set(Path(sharding._scratch.root(spark).removeprefix("file://")).glob("*"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert sharding.shard(docs).count() == 1500
        bytes_ = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    left = {p.name.split("-")[0] for p in set(Path(sharding._scratch.root(spark).removeprefix("file://")).glob("*")) - tables}
    assert left == {"sharded"}
    assert bytes_ < 400 * rows
