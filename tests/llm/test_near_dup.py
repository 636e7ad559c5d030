import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ODD, edited, groups, near_groups, odd_rows, prose

from netspark.llm import near_dup


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [prose(rng, rng.randint(60, 300)) for _ in range(150)]
    for i in range(150):
        out.append(edited(rng, out[i % 40], rng.choice([0.0, 0.01, 0.03, 0.06, 0.1])))
    return out


def test_groups_are_those_of_brute_force(spark, texts):
    found = {r["doc_id"]: r["keep_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root, d = near_groups(texts, near_dup.MAX_DISTANCE)
    assert np.sum(d[np.triu_indices(len(texts), 1)] <= near_dup.MAX_DISTANCE) > 200
    assert [found.get(i, i) for i in range(len(texts))] == root


def test_no_single_pair_is_lost_up_to_the_distance(spark):
    """Pairs by themselves, at the distances that edits of up to a fifth of the words give: all within the distance are found, no other."""
    rng = random.Random(9)
    texts = []
    for i in range(200):
        t = prose(rng, 200)
        texts += [t, edited(rng, t, rng.choice([0.03, 0.08, 0.12, 0.2]))]
    _, d = near_groups(texts, near_dup.MAX_DISTANCE)
    of = [int(d[i, i + 1]) for i in range(0, len(texts), 2)]
    assert sum(30 <= x <= near_dup.MAX_DISTANCE for x in of) > 15 and sum(x > near_dup.MAX_DISTANCE for x in of) > 15
    found = {r["doc_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {2 * i + 1 for i, x in enumerate(of) if x <= near_dup.MAX_DISTANCE}


@pytest.mark.parametrize("cell", [1_000_000, 150, 60])
def test_links_are_complete_at_any_size_of_cell(spark, cell):
    """Clusters whose members differ in up to the distance, and a large one, against all pairs; small cells are split by bits and into blocks."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (60, 4)).astype(np.uint64)
    s = centres[np.concatenate([np.arange(60), rng.integers(0, 60, 90), np.zeros(150, int)])]
    for row in s[60:]:
        for bit in rng.choice(256, rng.integers(10, 37), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    df = spark.createDataFrame([(f"d{i}", *row) for i, row in enumerate(s.view(np.int64).tolist())], "id string, s0 long, s1 long, s2 long, s3 long")
    rows = near_dup.similar_links(df, cell=cell).collect()
    distance = np.bitwise_count(s[:, None] ^ s[None]).sum(axis=-1)
    links = [(int(r["a"][1:]), int(r["b"][1:])) for r in rows]
    assert all(distance[a, b] == r["distance"] <= 36 for (a, b), r in zip(links, rows, strict=True))
    assert groups(len(s), links) == groups(len(s), [(i, j) for i, j in zip(*np.nonzero(distance <= 36), strict=True) if i < j])


def test_key_masks_are_all_differences_within_the_budgets():
    masks = set(near_dup.key_masks(36).tolist())
    d = [[int(x).bit_count() for x in ((m >> 16) & 255, (m >> 8) & 255, m & 255)] for m in sorted({0, *(sum(1 << i for i in c) for k in (1, 2, 3) for c in itertools.combinations(range(24), k))})]
    assert len(masks) == sum(a <= 1 and a + b <= 2 and a + b + c <= 3 for a, b, c in d)


def test_bucket_links_connect_what_pairs_connect():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (8, 4)).astype(np.uint64)
    s = centres[rng.integers(0, 8, 300)]
    for row in s:
        for bit in rng.choice(256, rng.integers(0, 30), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b, d = near_dup.bucket_links(s, 36, 8)
    distance = np.bitwise_count(s[:, None] ^ s[None]).sum(axis=-1)
    assert (distance[a, b] == d).all() and (d <= 36).all() and len(a) < len(s)
    assert groups(len(s), list(zip(a.tolist(), b.tolist(), strict=True))) == groups(len(s), [(i, j) for i, j in zip(*np.nonzero(distance <= 36), strict=True) if i < j])


def test_chains_never_lose_a_pair_within_the_distance():
    rng = np.random.default_rng(2)
    x = np.zeros((5000, 4), np.uint64)
    for row in x:
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.bitwise_count(x).sum(axis=1) <= 36
    ok = near_dup.viable(x, 8, 36)
    assert ok[near].all() and not ok.all()


def test_odd_rows(spark):
    rng = random.Random(4)
    t, long_ = prose(rng, 80), prose(rng, 60_000)
    texts = [t, None, "", t, "... !!", long_, edited(rng, long_, 0.01), "... !!", None, "word", "word"]
    df = spark.createDataFrame([*odd_rows(texts), (1, None, t, *["x"] * 3, 1, *["y"] * 5), odd_rows(texts)[0]], ODD)
    rows = {tuple(r) for r in near_dup.near_duplicates(df).collect()}
    assert rows == {(3, 0, 2), (6, 5, 2), (10, 9, 2)}
    left = near_dup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, 0), (False, 0), *[(False, i) for i in (1, 2, 4, 5, 7, 8, 9)], (True, 0)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_copies_is_one_group(spark):
    rng = random.Random(6)
    t = prose(rng, 150)
    df = spark.createDataFrame([(i, edited(rng, t, 0.02)) for i in range(600)], "doc_id long, text string")
    rows = near_dup.near_duplicates(df).collect()
    assert len(rows) == 599 and {(r["keep_id"], r["group_size"]) for r in rows} == {(0, 600)}


def test_hardly_a_pair_of_different_texts_is_looked_at_whole(monkeypatch):
    """Of 2 * 10^8 pairs of unrelated signatures; what is looked at one by one grows by the square of the table."""
    rng = np.random.default_rng(7)
    s = rng.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    s[1:101] = s[0]
    for row in s[1:101]:
        for bit in rng.choice(np.arange(64, 256), 10, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    looked, check = [], near_dup.Forest.check
    monkeypatch.setattr(near_dup.Forest, "check", lambda self, a, b: (looked.append(int(np.sum(a != b))), check(self, a, b))[1])
    a, b, d = near_dup.Forest(s, near_dup.MAX_DISTANCE, 8).links()
    assert sorted({*a.tolist(), *b.tolist()}) == list(range(101)) and len(a) == 100 and (np.bitwise_count(s[a] ^ s[b]).sum(axis=1) == d).all()
    assert sum(looked) < 101 * 101


@pytest.mark.parametrize("bits", [0, 3])
@pytest.mark.parametrize("most", [5, 36, 63])
def test_forests_of_all_segments_connect_what_all_pairs_connect(most, bits):
    """Large and small groups of near copies among others, in whole cells and in groups with their neighbours."""
    rng = np.random.default_rng(most)
    s = rng.integers(0, 2**64, (5000, 4), dtype=np.uint64)
    centre = np.concatenate([np.zeros(1200, int), rng.integers(1, 4, 900), rng.integers(4, 400, 900)])
    s[2000:] = s[centre]
    for row, n in zip(s[2000:], rng.integers(0, max(2, most), 3000), strict=True):
        for bit in rng.choice(256, n, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    s = np.unique(s, axis=0)[rng.permutation(len(np.unique(s, axis=0)))]
    links, starts = [], near_dup.ring(most)
    for place, start in enumerate(starts[:-1]):
        turned = near_dup.rotated(s, start)
        cells = near_dup._cells((turned[:, 0] & np.uint64((1 << bits) - 1)).astype(np.int64), bits)
        for g in range(1 << bits):
            rows = np.concatenate([rows[group == g] for group, rows in cells])
            a, b, d = near_dup.Forest(turned[rows], most, starts[place + 1] - start, g, bits).links()
            assert (np.bitwise_count(s[rows[a]] ^ s[rows[b]]).sum(axis=1) == d).all() and (d <= most).all()
            links += zip(rows[a].tolist(), rows[b].tolist(), strict=True)
    near = [(i, int(j)) for i in range(len(s)) for j in np.flatnonzero(np.bitwise_count(s[i] ^ s[i + 1 :]).sum(axis=1) <= most) + i + 1]
    assert near and groups(len(s), links) == groups(len(s), near)


def test_counts_in_slices_are_those_of_pairs():
    """Members in whole and in begun numbers of 64, limits up to where 7 stands for 8, and every number of skipped bits."""
    rng = np.random.default_rng(8)
    for n, skip, limit in [(1, 0, 2), (64, 13, 4), (65, 14, 5), (300, 40, 0), (1024, 8, 6)]:
        member, word = rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, 200, dtype=np.uint64)
        word[:100] = member[rng.integers(0, n, 100)] ^ (np.uint64(rng.integers(1, 256)) << np.uint64(skip + 8))
        a, b = near_dup.Sliced(member, skip).near(word, limit)
        few = np.bitwise_count((member[:, None] ^ word) >> np.uint64(skip) & np.uint64((1 << near_dup.SLICED) - 1)) <= limit
        assert len(a) == few.sum() and few[a, b].all()
    held = near_dup.Sliced(np.zeros(1, np.uint64), 8)
    word = (np.uint64(1) << np.arange(33, dtype=np.uint64)) - np.uint64(1)
    assert {int(x) for x in held.near(word, 9)[1]} >= set(range(18))


def test_large_tables_hardly_look_at_pairs_one_by_one(monkeypatch):
    """Buckets as large as those of 6 GB (180 signatures and more): nearly all pairs are counted 64 at a time."""
    rng = np.random.default_rng(9)
    s = rng.integers(0, 2**64, (100_000, 4), dtype=np.uint64)
    s[:, 0] &= ~np.uint64(31 << 8)
    s[1] = s[0] ^ np.uint64(1 << 20)
    one, count = [0], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, **more: (one.append(x.size), count(x, **more))[1])
    a, b, d = near_dup.Forest(s, near_dup.MAX_DISTANCE, 13).links()
    assert (sorted([*a.tolist(), *b.tolist()]), d.tolist()) == ([0, 1], [4])
    pairs = 100_000**2 / 2 * 9 / 256
    assert sum(one) < pairs / 10


def test_tallies_count_each_bit():
    rng = np.random.default_rng(10)
    bits = rng.integers(0, 2**64, (3, 50, near_dup.BLOCK), dtype=np.uint64)
    bits[0, 0] = 2**64 - 1
    counts = np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(3, 50, near_dup.BLOCK, 64).sum(axis=2)
    planes = [np.unpackbits(x.copy().view(np.uint8), bitorder="little").reshape(3, 50, 64).astype(int) for x in near_dup.tallies(bits)]
    assert (sum(x << k for k, x in enumerate(planes)) == counts).all()


def test_signatures_of_rows_of_any_length_are_those_of_a_plain_count():
    """Around blocks of 16 and runs of 240 words, and beyond what a byte counts; rows without words between."""
    rng = random.Random(12)
    sizes = [1, 15, 16, 17, 0, 239, 240, 241, 480, 481, 0, 5000, 2]
    texts = [" ".join(f"w{rng.getrandbits(60)}" for _ in range(n)) for n in sizes]
    found, n = near_dup.simhash(pa.array(texts, pa.large_string()))
    assert n.tolist() == sizes
    for text, row in zip(texts, found, strict=True):
        hashes = near_dup.Splitter().words(pa.array([text], pa.large_string())).hash
        word = near_dup.mix(np.unique(hashes >> np.uint64(18)))
        counts = np.zeros(256, int)
        for k in range(4):
            lane = near_dup.mix(word + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            counts[64 * k : 64 * k + 64] = np.unpackbits(lane.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
        assert (np.packbits(2 * counts > len(word)).view(np.int64) == row).all()
