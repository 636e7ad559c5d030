import random
from collections import Counter

import numpy as np
import pytest
from brute import prose

from netspark.llm import html_extract, url_filter


def brute_covered(pages: list[list[int]], least: int, on: int) -> list[list[bool]]:
    where: dict[tuple, set[int]] = {}
    for i, p in enumerate(pages):
        for k in range(len(p) - least + 1):
            where.setdefault(tuple(p[k : k + least]), set()).add(i)
    out = []
    for p in pages:
        gone = [False] * len(p)
        for k in range(len(p) - least + 1):
            if len(where[tuple(p[k : k + least])]) >= on:
                gone[k : k + least] = [True] * least
        out.append(gone)
    return out


@pytest.mark.parametrize(("least", "on"), [(2, 2), (4, 2), (8, 2), (8, 3)])
def test_suffix_array_against_brute_force(least, on):
    rng = random.Random(least + on)
    shared = [[rng.randint(0, 50) for _ in range(rng.randint(4, 20))] for _ in range(4)]
    pages = [sum((rng.choice(shared) if rng.random() < 0.4 else [rng.randint(0, 50) for _ in range(rng.randint(0, 9))] for _ in range(6)), []) for _ in range(25)] + [[], [1]]
    tokens, page = np.array(sum(pages, [])), np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    assert html_extract.repeated(tokens, page, least, on).tolist() == sum(brute_covered(pages, least, on), [])


def site(rng: random.Random, n: int, host: str, first: int) -> list[tuple]:
    menu, foot = prose(rng, 15), prose(rng, 30)
    return [(first + i, f"https://{host}/a/{i}", f"<html><nav>{menu}</nav><script>x()</script><p>{prose(rng, 60)}</p><footer>{foot} &amp; more</footer></html>") for i in range(n)]


def test_boilerplate_goes_and_the_size_of_blocks_does_not_matter(spark):
    rng = random.Random(3)
    rows = site(rng, 30, "one.example", 0) + site(rng, 3, "two.example", 100) + site(rng, 1, "three.example", 200)
    rows += [(300, None, "<p>no host at all</p>"), (301, None, "<p>no host at all</p>"), (302, "https://one.example/x", None), (303, "https://one.example/y", ""), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {tuple(r) for r in html_extract.extract(df).collect()}
    split = {tuple(r) for r in html_extract.extract(df, block_bytes=2000).collect()}
    assert whole == split and len(whole) == len({(r[0], r[1], r[2]) for r in rows}) - 0
    by = {r[0]: r for r in whole}
    assert by[5][3] == 15 + 60 + 32 and by[5][4] == 60
    assert by[200][4] == by[200][3] and by[300][2] == "no host at all" and by[300][1] is None
    assert by[302][2:] == (None, 0, 0) and by[303][2:] == ("", 0, 0)
    assert by[0][4] >= 58  # rows that repeat a page are one page; a word or two may follow the menu on other pages too
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_extract(rows: list[tuple]) -> set[tuple]:
    """page_id, kept tokens in order and their number, with plain lists; texts hold no markup but one paragraph."""
    out = set()
    hosts = {u.split("/")[2] for _, u, _ in rows}
    for name in hosts:
        own = [(i, h.removeprefix("<p>").removesuffix("</p>").split()) for i, u, h in rows if u.split("/")[2] == name]
        first: dict[tuple, int] = {}
        for i, t in own:
            first[tuple(t)] = min(i, first.get(tuple(t), i))
        pages = {i: t for i, t in own if first[tuple(t)] == i}
        gone = dict(zip(pages, brute_covered(list(pages.values()), html_extract.LEAST, html_extract.PAGES), strict=True))
        for i, t in own:
            kept = [w for w, g in zip(t, gone[i], strict=True) if not g] if i in pages else []
            out.add((i, " ".join(kept), len(t), len(kept)))
    return out


@pytest.mark.parametrize("block_bytes", [html_extract.BLOCK_BYTES, 1500])
def test_extraction_against_brute_force(spark, block_bytes):
    """Equal pages, on which the first keeps its text, passages that pages share, short unique runs between them, and a very long page."""
    rng = random.Random(12)
    shared = [prose(rng, rng.choice([7, 8, 9, 60])) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [rng.choice(shared) if rng.random() < 0.5 else prose(rng, rng.choice([1, 2, 12])) for _ in range(5)]
        rows.append((i, f"https://{rng.choice(['a', 'b'])}.example/{i}", f"<p>{' '.join(parts)}</p>"))
    rows += [(100 + i, *rows[i][1:]) for i in range(6)] + [(110 + i, *rows[0][1:]) for i in range(20)] + [(200, "https://a.example/long", f"<p>{prose(rng, 40_000)} {shared[3]}</p>"), rows[5]]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    assert {(r["page_id"], " ".join(r["text"].split()), r["n_tokens"], r["n_kept"]) for r in got} == brute_extract(rows)


def test_null_ids_and_copies(spark):
    text = "<p>" + " ".join(f"w{i}" for i in range(30)) + "</p>"
    df = spark.createDataFrame([(None, "https://a.b/1", text), (7, "https://a.b/2", text), (9, "https://a.b/3", text), (9, "https://c.d/3", text)], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["host"], r["n_tokens"], r["n_kept"]) for r in html_extract.extract(df).collect()) == [(0, "a.b", 30, 0), (7, "a.b", 30, 30), (9, "a.b", 30, 0), (9, "c.d", 30, 30)]


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "https://a.b/c", "<p>just some text</p>", "h", 1, "x", [3])], "page_id long, url string, html string, host string, block long, text string, keys array<int>")
    assert html_extract.extract(df).collect()[0][:3] == (1, "a.b", "just some text")


def brute_templates(rows: list[tuple[str, tuple, int | None]], smoothing: float = url_filter.SMOOTHING) -> dict[tuple, tuple]:
    """(template, pages, labelled, good, purity) of every (host, path), by recursion over plain trees; rows are host, segments, label."""
    labels = [x for *_, x in rows if x is not None]
    rate = sum(labels) / len(labels) if labels else 1.0
    out = {}
    for name in {h for h, *_ in rows}:
        own = [(p, x) for h, p, x in rows if h == name]

        def done(below: list[tuple], d: int) -> dict[tuple, tuple]:
            """The wildcarded path of every path below a node, whose pages share d segments."""
            if len({p for p, _ in below}) == 1:
                return {below[0][0]: below[0][0][d:]}
            here = Counter(p[d] for p, _ in below if len(p) > d)
            total = sum(here.values())
            names = {c: c if len(here) == 1 or n * n >= total else "*" for c, n in here.items()}
            found = {p: () for p, _ in below if len(p) == d}
            for label in set(names.values()):
                part = [(p, x) for p, x in below if len(p) > d and names[p[d]] == label]
                # paths that meet in a wildcard branch again by their next segments
                found |= {p: (label, *rest) for p, rest in done(part, d + 1).items()} if len({p for p, _ in part}) > 1 or label != "*" else {part[0][0]: ("*", *part[0][0][d + 1 :])}
            return found

        templates = done(own, 0)

        def merge(node: list[tuple[tuple, tuple, int, int]]) -> list[tuple[tuple, tuple, int, int]]:
            """Leaves (original, rest, labelled, good) below a node with merged rests."""
            leaves = [x for x in node if not x[1]]
            children = []
            for c in {x[1][0] for x in node if x[1]}:
                kids = merge([(o, r[1:], n, g) for o, r, n, g in node if r and r[0] == c])
                children.append((c, kids, sum(k[2] for k in kids), sum(k[3] for k in kids)))
            groups = []
            for c, kids, n, g in sorted(children, key=lambda x: (-x[2], x[0])):
                for group in groups:
                    p = (group["g"] + g) / max(1, group["n"] + n)
                    if n and group["n"] and group["shape"] == {k[1] for k in kids} and abs(g / n - group["g"] / group["n"]) <= url_filter.Z * (p * (1 - p) * (1 / n + 1 / group["n"])) ** 0.5:
                        group["names"].append(c)
                        group["kids"] += kids
                        group["n"] += n
                        group["g"] += g
                        break
                else:
                    groups.append({"names": [c], "kids": kids, "n": n, "g": g, "shape": {k[1] for k in kids}})
            for group in groups:
                label = group["names"][0] if len(group["names"]) == 1 else "(" + "|".join(sorted(group["names"])) + ")"
                leaves += [(o, (label, *r), n, g) for o, r, n, g in group["kids"]]
            return leaves

        count = {t: [x for p, x in own if templates[p] == t and x is not None] for t in set(templates.values())}
        named = {o: r for o, r, *_ in merge([(t, t, len(x), sum(x)) for t, x in count.items()])}
        for p, t in templates.items():
            purity, size = rate, None
            for d in range(len(named[t]) + 1):
                below = [x for q, x in own if named[templates[q]][:d] == named[t][:d]]
                seen = [x for x in below if x is not None]
                if len(below) != size:
                    purity, size = (sum(seen) + smoothing * purity) / (len(seen) + smoothing), len(below)
            every = [x for q, x in own if named[templates[q]] == named[t]]
            known = [x for x in every if x is not None]
            out[name, p] = ("/" + "/".join(named[t]), len(every), len(known), sum(known), purity)
    return out


def test_templates_against_brute_force(spark):
    """Sections of good and bad pages, variable segments at several depths, unlabelled branches and paths of 40 segments."""
    rng = random.Random(21)
    rows = []
    for i in range(700):
        h = rng.choice(["a.example", "a.example", "b.example"])
        kind = rng.choice(["news", "blog", "spam", "tag", "shop", "deep", "new"])
        parts = {"news": ["news", "x"], "blog": ["blog", "x"], "spam": ["spam", "x"], "tag": ["tag", prose(rng, 1).strip(".").lower(), "y"], "shop": ["shop", rng.choice("abc"), "z"], "deep": ["deep", *(rng.choice("pq") for _ in range(rng.randint(0, 3))), *["r"] * 40], "new": [prose(rng, 1).strip(".").lower()]}[kind]
        rows.append((h, tuple(parts), None if kind == "new" or i % 4 == 0 else int(rng.random() > (0.8 if kind == "spam" else 0.1))))
    pages = spark.createDataFrame([(i, f"https://{h}/" + "/".join(p)) for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, (*_, x) in enumerate(rows) if x is not None], "doc_id long, quality int")
    out = url_filter.filter_urls(pages, labels, key=pages["page_id"]).collect()
    expected = brute_templates(rows)
    assert len(out) == len(rows)
    for r in out:
        h, p, _ = rows[r["page_id"]]
        template, n, labelled, good, purity = expected[h, p]
        assert (r["template"], r["n_pages"], r["n_labelled"], r["n_good"]) == (template, n, labelled, good)
        assert abs(r["purity"] - purity) < 1e-9 and r["keep"] == (r["purity"] >= url_filter.PURITY)
    gone = {rows[r["page_id"]][1][0] for r in out if not r["keep"]}
    assert "spam" in gone and not gone & {"news", "blog", "tag", "shop"} and any("|" in r["template"] for r in out) and any("*" in r["template"] for r in out)


def test_templates_of_bad_pages_go(spark):
    rows, labels = [], []
    for i in range(60):
        rows += [(i, f"https://h.example/news/{i}"), (100 + i, f"https://h.example/spam/x{100 + i}/p"), (200 + i, f"https://g.example/{prose(random.Random(i), 1)}/{200 + i}")]
        labels += [(i, 1), (100 + i, 0), (200 + i, int(i % 10 > 0))]
    rows += [(900, None), (901, "no url"), (902, "https://h.example"), (0, "https://h.example/news/0")]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "page_id long, url string, host string, template string")
    out = url_filter.filter_urls(df, spark.createDataFrame([*labels, (0, 0), (None, 1), (5, 1)], "doc_id long, quality int"))
    found = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    assert found[1]["template"] == "/news/{num}" and found[1]["keep"] and found[1]["n_pages"] == 61
    assert found[101]["template"] == "/spam/x{n}/p" and not found[101]["keep"] and found[101]["n_good"] == 0
    assert found[0]["n_labelled"] == 59  # contradictory labels count as none
    assert "*" in found[201]["template"] and found[201]["keep"]
    assert all(found[i]["keep"] and found[i]["template"] is None for i in (900, 901)) and found[902]["template"] == "/"
    rate = (59 + 54) / (59 + 60 + 60)
    host = (59 + 10 * rate) / (59 + 60 + 10)
    assert abs(found[101]["purity"] - host * 10 / 70) < 1e-9  # all of /spam is /spam/x{n}/p
    assert url_filter.filter_urls(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
    assert all(r["keep"] for r in url_filter.filter_urls(df, spark.createDataFrame([], "doc_id long, quality int")).collect())


def test_only_siblings_that_do_not_differ_merge():
    labels = url_filter.merge_siblings([("a", (1,), 50, 45), ("b", (1,), 40, 36), ("c", (1,), 50, 5), ("d", (2,), 9, 8), ("e", (1,), 0, 0)])
    assert labels == {"a": "(a|b)", "b": "(a|b)", "c": "c", "d": "d", "e": "e"}
    many = url_filter.merge_siblings([(f"s{i:02}", (), 10, 5) for i in range(20)])
    assert set(many.values()) == {"(" + "|".join(f"s{i:02}" for i in range(8)) + "|+12)"}
