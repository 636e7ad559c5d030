"""URL filter: a tree of path templates per host."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.llm import _scratch

#: Branches merge if their rates of good pages differ by less than so many standard errors.
Z = 1.96
#: Smoothing in pages towards the rate of the branch above, and the least smoothed purity that stays.
SMOOTHING, PURITY = 10.0, 0.6
WILD = "*"
#: Names of merged branches that a label lists; of more it gives the number, so that labels stay short.
NAMED = 8
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def url_key(url: Column) -> Column:
    """Last number in a URL's path, as a long; null if there is none."""
    return F.regexp_extract(F.regexp_extract(url, _PATH, 1), r"(\d{1,18})[^\d]*$", 1).try_cast("long")


def segments(url: Column) -> Column:
    """Path segments with those that look variable typed: numbers, hexadecimal and other identifiers; digits within other segments are generalised."""
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")

    def typed(s: Column) -> Column:
        extension = F.regexp_extract(s, r"(\.[A-Za-z]{2,5})$", 1)
        stem = F.substring(s, F.lit(1), F.length(s) - F.length(extension))
        kind = F.when(stem.rlike(r"^\d+$"), "{num}").when(stem.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "{date}").when(stem.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "{uuid}").when(stem.rlike(r"^(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}$"), "{hex}").otherwise(F.regexp_replace(stem, r"\d+", "{n}"))
        return F.concat(kind, F.lower(extension))

    return F.transform(parts, typed)


def _close(a: tuple[int, int], b: tuple[int, int], z: float) -> bool:
    """Whether two (labelled, good) could well have one rate; without labels on both sides nothing says so."""
    if not a[0] or not b[0]:
        return False
    p = (a[1] + b[1]) / (a[0] + b[0])
    return abs(a[1] / a[0] - b[1] / b[0]) <= z * math.sqrt(p * (1 - p) * (1 / a[0] + 1 / b[0]))


def merge_siblings(children: list[tuple[str, tuple, int, int]], z: float = Z) -> dict[str, str]:
    """The label of each child (name, shape, labelled, good) of one node.

    Children merge one by one, those with most labelled pages (then by name)
    first, each with the first group of its shape whose rate of good pages
    differs by at most z standard errors; unlabelled ones stay apart.
    """
    groups: dict[tuple, list[tuple[list[str], list[int]]]] = {}
    for name, shape, labelled, good in sorted(children, key=lambda c: (-c[2], c[0])):
        for names, total in groups.setdefault(shape, []):
            if _close((total[0], total[1]), (labelled, good), z):
                names.append(name)
                total[0] += labelled
                total[1] += good
                break
        else:
            groups[shape].append(([name], [labelled, good]))
    out = {}
    for names, _ in (g for own in groups.values() for g in own):
        names.sort()
        more = [f"+{len(names) - NAMED}"] if len(names) > NAMED else []
        label = names[0] if len(names) == 1 else "(" + "|".join(names[:NAMED] + more) + ")"
        out |= dict.fromkeys(names, label)
    return out


def templates(counted: DataFrame) -> DataFrame:
    """counted (host, path, n, labelled, good) with ``done``: the path with its variable segments as wildcards.

    Level by level from the root: of the N pages below a node, a segment that
    is on fewer than the square root of N is one of its variable ones, so a
    node has at most that many others; a node of one segment has no
    variable one. Once a branch has a single path, that path is done, so there are as
    many rounds as paths branch, at any depth.
    """
    level, finished = _scratch.write(counted.withColumn("done", F.array().cast("array<string>")), "paths"), []
    depth, still = 0, 1
    while still:
        child = F.try_element_at("path", F.lit(depth + 1))
        here = level.withColumn("child", child)
        branch = here.groupBy("host", "done", "child").agg(F.sum("n").alias("here"), F.count("*").alias("paths"))
        below = F.col("child").isNotNull()
        node = branch.groupBy("host", "done").agg(F.sum(F.when(below, F.col("here"))).alias("all"), F.count("child").alias("children"), F.sum("paths").alias("paths"))
        known = branch.drop("paths").join(node, ["host", "done"]).select(F.col("host").alias("h"), F.col("done").alias("d"), F.col("child").alias("c"), ((F.col("children") == 1) | (F.col("here") * F.col("here") >= F.col("all"))).alias("literal"), (F.col("paths") == 1).alias("single"))
        step = here.join(known, (F.col("host") == F.col("h")) & (F.col("done") == F.col("d")) & F.col("child").eqNullSafe(F.col("c")))
        done = F.when(F.col("single"), F.concat("done", F.slice("path", depth + 1, 1 << 30))).when(F.col("child").isNull(), F.col("done")).otherwise(F.concat("done", F.array(F.when(F.col("literal"), F.col("child")).otherwise(WILD))))
        is_open = ~F.col("single") & (F.size("path") > depth + 1)
        then, seen = _scratch.measured(step.select(*counted.columns, done.alias("done"), is_open.alias("open")), "paths", F.count_if("open").alias("open"))
        _scratch.drop(level)
        finished.append(then.where("NOT open").drop("open"))
        if still := seen["open"]:
            level, depth = _scratch.write(then.where("open").drop("open"), "paths"), depth + 1
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def merged(leaves: DataFrame, z: float = Z) -> DataFrame:
    """leaves (host, done, labelled, good) with ``name``: done with the labels of merge_siblings(), from the deepest level to the root.

    Siblings have one shape if the labelled paths below them are the same. A node's
    children, at most the square root of its pages and one more, are all that
    one task compares; of what is below them it sees a hash.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("parent", T.ArrayType(T.StringType())), T.StructField("child", T.StringType()), T.StructField("label", T.StringType())])

    def one_node(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.to_pydict()
        labels = merge_siblings(list(zip(x["child"], zip(x["x"], x["y"], x["leaves"], strict=True), x["labelled"], x["good"], strict=True)), z)
        n = len(labels)
        return pa.table([pa.array([key[0].as_py()] * n, pa.string()), pa.array([key[1].as_py()] * n, pa.list_(pa.string())), pa.array(list(labels), pa.string()), pa.array(list(labels.values()), pa.string())], names=schema.names)

    now = _scratch.write(leaves.withColumn("name", F.col("done")), "names")
    levels = now.select("host", F.explode(F.transform("done", lambda child, i: F.struct(F.slice("done", 1, i).alias("parent"), child.alias("child")))).alias("x"))
    branching = levels.groupBy("host", "x.parent").agg(F.min("x.child").alias("low"), F.max("x.child").alias("high")).where("low <> high").select(F.size("parent").alias("d")).distinct().collect()
    for d in sorted((x["d"] for x in branching), reverse=True):
        below = now.where(F.size("done") > d).select("host", F.slice("done", 1, d).alias("parent"), F.element_at("done", d + 1).alias("child"), F.slice("name", d + 2, 1 << 30).alias("rest"), "labelled", "good")
        paths = below.groupBy("host", "parent", "child", "rest").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        shapes = paths.groupBy("host", "parent", "child").agg(F.bit_xor(F.xxhash64("rest")).alias("x"), F.bit_xor(F.xxhash64("rest", F.lit(1))).alias("y"), F.count("*").alias("leaves"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
        labels = shapes.groupBy("host", "parent").applyInArrow(one_node, schema).where("label <> child")
        step = now.select("*", F.slice("done", 1, d).alias("parent"), F.try_element_at("done", F.lit(d + 1)).alias("child")).join(labels, ["host", "parent", "child"], "left")
        name = F.when(F.col("label").isNull(), F.col("name")).otherwise(F.concat(F.slice("name", 1, d), F.array("label"), F.slice("name", d + 2, 1 << 30)))
        then = _scratch.write(step.select(*leaves.columns, name.alias("name")), "names")
        _scratch.drop(now)
        now = then
    return now


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", key: Column | None = None, label_key: str = "doc_id", label_col: str = "quality", z: float = Z, smoothing: float = SMOOTHING, purity: float = PURITY) -> DataFrame:
    """``page_id, url, host, template, n_pages, n_labelled, n_good, purity, keep`` of every row of pages.

    Whole paths become templates with wildcards for variable segments
    (templates()), branches that don't differ merge (merged()), and a template
    is rejected if its purity is under the limit: (good + smoothing * above) /
    (labelled + smoothing), where above is the purity of the next larger branch by the
    same rule, that of the whole table above hosts. So a template without
    labels has the purity of its branch. key tells under which
    label_key a page is labelled: by default the last number in its path; keys
    with contradictory labels count as unlabelled. Pages without a host or
    with a null URL have null template and purity and stay; null ids and repeated rows
    count and are returned each; paths are never cut, however long; an empty table gives no rows, without labels
    the rate is 1 and all stay; extra columns are ignored.
    """
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), *([] if key is None else [key.alias("key")]))
    base = base.select("page_id", "url", host(F.col("url")).alias("host"), segments(F.col("url")).alias("path"), (url_key(F.col("url")) if key is None else F.col("key")).alias("key"))
    clean = labels.select(F.col(label_key).alias("key"), F.col(label_col).cast("int").alias("good")).where("key IS NOT NULL AND good IN (0, 1)").groupBy("key").agg(F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").select("key", "good")
    counted = base.where("host IS NOT NULL").select("host", "path", "key").join(clean, "key", "left").groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    paths = _scratch.write(templates(_scratch.write(counted, "counted")), "templates")
    rate = paths.agg(F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0]
    named = merged(paths.groupBy("host", "done").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("good").alias("good")), z)
    whole = _scratch.write(named.groupBy("host", "name").agg(F.sum("n").alias("n_pages"), F.sum("labelled").alias("n_labelled"), F.sum("good").alias("n_good")), "whole")
    # Every branch's labels, from the host down, once for each template below it.
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.size("name")), lambda i: F.slice("name", 1, i))).alias("prefix")
    above = whole.select("host", "name", "n_pages", "n_labelled", "n_good", prefix)
    branch = above.groupBy("host", "prefix").agg(F.sum("n_pages").alias("n"), F.sum("n_labelled").alias("l"), F.sum("n_good").alias("g"))
    chain = above.select("host", "name", "prefix").join(branch, ["host", "prefix"]).groupBy("host", "name").agg(F.sort_array(F.collect_list(F.struct(F.size("prefix").alias("depth"), "n", "l", "g"))).alias("chain"))
    # A branch of the same pages as the one above it tells nothing new.
    first = F.struct(F.lit(1.0 if rate is None else float(rate)).alias("p"), F.lit(-1).cast("long").alias("n"))
    smooth = F.aggregate("chain", first, lambda t, x: F.when(t["n"] == x["n"], t).otherwise(F.struct(((x["g"] + smoothing * t["p"]) / (x["l"] + smoothing)).alias("p"), x["n"].alias("n"))), lambda t: t["p"])
    verdict = whole.join(chain, ["host", "name"]).select("host", "name", F.concat(F.lit("/"), F.array_join("name", "/")).alias("template"), "n_pages", "n_labelled", "n_good", smooth.alias("purity"))
    verdict = _scratch.write(paths.select("host", "path", "done").join(named.select("host", "done", "name"), ["host", "done"]).join(verdict, ["host", "name"]).select("host", "path", "template", "n_pages", "n_labelled", "n_good", "purity"), "verdict")
    return base.select("page_id", "url", "host", "path").join(_scratch.hinted(verdict, 100_000), ["host", "path"], "left").select("page_id", "url", "host", "template", "n_pages", "n_labelled", "n_good", "purity", F.coalesce(F.col("purity") >= purity, F.lit(True)).alias("keep"))
