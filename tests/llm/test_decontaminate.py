import random

import pytest
from brute import ODD, contained, edited, odd_rows, prose
from compare import connection, difference

from netspark.llm import decontaminate
from netspark.llm import queries as llm


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    items = [prose(rng, rng.randint(6, 60)) for _ in range(12)] + ["to be or", "same words here again same words here again same words here again"]
    texts = []
    for i in range(80):
        t = prose(rng, rng.randint(5, 400)).split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = edited(rng, rng.choice(items), rng.choice([0, 0.05, 0.1, 0.2])).upper().split()
        texts.append(" ".join(t))
    texts.append(" ".join(items[0].split()[:20] * 300))
    return texts, items


def test_against_brute_force(spark, case):
    texts, items = case
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for sent in (decontaminate.SENT_SHINGLES, 0):
        mine = {(r["doc_id"], r["item_id"]): (r["containment"], r["window_start"], r["item_shingles"]) for r in decontaminate.contaminated(docs, bench, sent=sent).collect()}
        brute = {(i, j): c for i, t in enumerate(texts) for j, x in enumerate(items) if (c := contained(t, x, decontaminate.SHINGLE))[0] >= decontaminate.THRESHOLD}
        assert mine == brute and len(brute) > 20


def test_against_sql(spark, sf):
    df = llm.op7_decontamination(spark, sf)
    q = connection(sf).execute(llm.oracle_sql()["op7_decontamination"])
    assert difference(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in q.description], q.fetchall()) == ""


def test_an_item_repeated_many_times_in_a_long_text(spark):
    rng = random.Random(2)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, (item + " ") * 2000), (2, "nothing here at all")], "doc_id long, text string")
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"], r["window_start"]) for r in rows] == [(1, 5, 1.0, 0)]


def test_odd_rows(spark, case):
    item = case[1][0]
    texts = [item, None, "", item, "short"]
    df = spark.createDataFrame([*odd_rows(texts), odd_rows(texts)[0], (1, None, item, *["x"] * 3, 1, *["y"] * 5)], ODD)
    bench = spark.createDataFrame([(3, item, "z"), (4, None, "z"), (None, item, "z"), (5, "one two", "z"), (3, item, "z")], "item_id long, text string, shingle string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == {(0, 3), (3, 3)}
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "4", "None"]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 == decontaminate.contaminated(df, bench.limit(0)).count()
