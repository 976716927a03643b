import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout

ITEMS = "doc long, page int, id long, str string, x double, y double, width double, height double, bold boolean"


def column(x, texts, y0=700, doc=1, page=1, start=0, step=14, width=220.0, height=10.0):
    return [(doc, page, start + k, t, float(x), float(y0 - step * k), width, height, False) for k, t in enumerate(texts)]


@pytest.fixture
def two_columns(spark):
    left = column(54, [f"left column words number {k}" for k in range(12)])
    right = column(330, [f"right column words number {k}" for k in range(12)], start=100)
    wide = [(1, 1, 999, "A full width heading line over both of the columns", 54.0, 740.0, 500.0, 12.0, True)]
    rows = left + right + wide
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("order", ["columns", "xy-cut"])
def test_two_columns_in_order(two_columns, order):
    got = [r["text"] for r in layout.lines(two_columns, order=order).orderBy("ord").collect()]
    assert got[0].startswith("A full width") and got[1:13] == [f"left column words number {k}" for k in range(12)]
    assert got[13:] == [f"right column words number {k}" for k in range(12)]


def line(text, x, y, width):
    return {"text": text, "x": x, "y": y, "width": width, "height": 10, "bold": False, "items": []}


def test_three_columns_and_aside():
    cols = [line(f"c{c}r{r}", 50 + 180 * c, 700 - 14 * r, 150) for r in range(10) for c in range(3)]
    assert [l["text"] for l in layout.xy_cut(cols)] == [f"c{c}r{r}" for c in range(3) for r in range(10)]
    body = [line(f"b{c}{r:02}", 160 + 190 * c, 700 - 14 * r, 170) for r in range(12) for c in range(2)]
    aside = [line(f"a{r}", 50, 690 - 14 * r, 70) for r in range(8)]
    assert [l["text"] for l in layout.xy_cut(body + aside)] == sorted(l["text"] for l in body) + [f"a{r}" for r in range(8)]
    assert layout.xy_cut([]) == []


def test_running_mean_lines():
    class It:
        def __init__(self, y):
            self.y, self.x, self.height = y, 0, 10

    assert [len(g) for g in layout.y_clusters([It(100), It(97), It(93), It(80)])] == [2, 1, 1]
    assert [len(g) for g in layout.y_clusters([It(100), It(99), It(98), It(90)])] == [3, 1]


def test_blocks_join_lines_and_labels(spark):
    rows = column(54, ["1 Introduction"], y0=720) + column(54, ["This paragraph goes over some lines and breaks a hyphen-", "ated word at the end of the line here", "and ends here."], y0=690, start=10)
    rows += column(54, ["Figure 1. A caption of the figure."], y0=600, start=20)
    got = [(r["label"], r["text"]) for r in layout.blocks(spark.createDataFrame(rows, ITEMS)).orderBy("ord").collect()]
    assert ("caption", "Figure 1. A caption of the figure.") in got and ("heading", "1 Introduction") in got
    assert any("hyphenated word" in t for _, t in got)


def test_join_flow_is_idempotent(spark):
    rows = [(1, 1, 0, "text", "The sentence goes on"), (1, 1, 1, "text", "in the next block and ends."), (1, 1, 2, "text", "Another one with a hyphen-"), (1, 1, 3, "text", "ated end"), (1, 1, 4, "formula", "x = y"), (1, 2, 0, "text", "Alone.")]
    df = spark.createDataFrame(rows, "doc long, page int, ord int, label string, text string")
    once = layout.join_flow(df)
    got = {(r["page"], r["ord"]): (r["text"], r["skip"], r["flow_host"]) for r in once.collect()}
    assert got[1, 0] == ("The sentence goes on in the next block and ends.", False, None) and got[1, 1][1:] == (True, 0)
    assert got[1, 2][0] == "Another one with a hyphenated end" and got[1, 4] == ("x = y", False, None)
    again = layout.join_flow(once.where("not skip").drop("skip", "flow_host"))
    assert {r["text"] for r in again.where("not skip").collect()} == {t for t, s, _ in got.values() if not s}


def test_page_boundary(spark):
    rows = [(1, 1, 0, "text", "First."), (1, 1, 1, "text", "It goes on"), (1, 2, 0, "text", "over the page."), (1, 4, 0, "text", "no neighbour")]
    df = spark.createDataFrame(rows, "doc long, page int, ord int, label string, text string")
    assert [tuple(r) for r in layout.join_pages(df).collect()] == [(1, 1, 1, 2, 0)]


def test_bands_and_clusters(spark):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 12, 20), (1, 1, 60, 70), (1, 1, 5, 8)], "doc long, page int, top int, bottom int")
    assert sorted((r["top"], r["bottom"]) for r in layout.merge_bands(df).collect()) == [(0, 20), (60, 70)]
    assert [(r["top"], r["bottom"]) for r in layout.uncovered(df, 100.0).collect()] == [(20, 60)]
    hits = spark.createDataFrame([(1, p) for p in (1, 2, 20, 22, 24, 50)], "doc long, pos long")
    assert tuple(layout.largest_cluster(hits).first()) == (1, 20, 24, 3)


def test_outline(spark):
    df = spark.createDataFrame([(1, 1, 0, "heading", "2.1.3 Deep"), (1, 1, 1, "heading", "Plain"), (1, 1, 2, "text", "1 no")], "doc long, page int, ord int, label string, text string")
    assert [(r["number"], r["level"]) for r in layout.outline(df).orderBy("ord").collect()] == [("2.1.3", 3), (None, 1)]
    nested = spark.createDataFrame([(1, [("A", 1, [("B", 2)])])], "doc long, items array<struct<title:string,page:int,items:array<struct<title:string,page:int>>>>")
    assert [(r["path"], r["level"], r["title"]) for r in layout.flatten_outline(nested).orderBy("path").collect()] == [([0], 1, "A"), ([0, 0], 2, "B")]
    entries = spark.createDataFrame([(1, 0, 10.0, "A"), (1, 1, 50.0, "B"), (2, 0, 90.0, "C")], "doc long, ord int, y double, title string")
    assert {r["doc"]: r["title"] for r in layout.current_entry(entries, 55.0).collect()} == {1: "B", 2: "C"}


def test_references_are_skipped(spark):
    df = spark.createDataFrame([(1, 1, 0, "text", "a"), (1, 1, 1, "heading", "References"), (1, 2, 0, "text", "b"), (1, 2, 1, "heading", "Appendix A"), (1, 2, 2, "text", "c")], "doc long, page int, ord int, label string, text string")
    assert [r["skip"] for r in layout.relabel_references(df).orderBy("page", "ord").collect()] == [False, True, True, False, False]


def test_prelabel_and_units(spark):
    rows = [(1, 0, "x", "CMMI10", 10.0, 0.0, 16.0, 10.0), (1, 1, "2", "CMR7", 16.0, -2.0, 20.0, 4.0), (1, 2, "word", "Times", 30.0, 0.0, 60.0, 10.0), (1, 3, "code", "CMTT10", 70.0, 0.0, 90.0, 10.0)]
    e = spark.createDataFrame(rows, "page int, id long, char string, font string, x0 double, y0 double, x1 double, y1 double")
    lab = layout.prelabel(e)
    assert {r["id"]: (r["label"], r["role"]) for r in lab.collect()}[0] == ("formula", "base")
    assert {r["id"]: r["label"] for r in lab.collect()}[3] == "code"
    u = layout.prelabel_units(lab, e, 600.0).collect()
    assert u and {r["type"] for r in u} == {"inline"} and all(r["confidence"] <= 0.95 for r in u)
    ed = spark.createDataFrame([(1, "a", "u1", False)], "page int, id string, unitId string, equationNumber boolean")
    new = layout.apply_edits(ed, spark.createDataFrame([(1, "a", "u2", None)], "page int, id string, unitId string, equationNumber boolean")).first()
    assert (new["unitId"], new["equationNumber"]) == ("u2", False)


def test_column_cut(spark):
    rows = [(1, 1, float(x + k % 5)) for x in (50, 320) for k in range(10)]
    df = spark.createDataFrame(rows, "doc long, page int, x0 double")
    assert layout.column_cut(df).first()["cut"] >= 320
    assert layout.typical_height(spark.createDataFrame([(1, 1, h) for h in (9.6, 10.4, 12.0, 12.2)], "doc long, page int, height double")).first()["typical"] == 10


def test_lines_of_a_page_at_once():
    """The lines of ``build_lines`` without a look at each item; pages whose rows touch, or with white space or holes, go the long way."""
    rng, taken, splits = random.Random(5), 0, set()
    for n in range(300):
        step, touch = rng.choice([14.0, 5.5, 3.0]), rng.random() < 0.2
        words = ["".join(rng.choice("abcé字-") for _ in range(rng.choice([1, 3, 6]))) for _ in range(rng.choice([1, 5, 40, 200]))]
        columns, per = rng.choice([([54.0], 6), ([54.0, 324.0], 6), ([54.0, 170.0, 400.0], 3)])
        own = []
        for k, w in enumerate(words):
            row, col = divmod(k // per, len(columns))
            y = 700.0 - row * step + (rng.choice([0.0, 0.4]) if touch else 0.0)
            own.append(layout.Item(k, w, columns[col] + k % per * rng.choice([40.0, 40.0, 38.0]), y, min(len(w), 7) * rng.choice([5.0, 6.0]), rng.choice([9.0, 10.0]), rng.random() < 0.5))
        if n % 10 == 9:
            own[0] = own[0]._replace(str=rng.choice([None, "", " ", "a b", "a "]))
        rng.shuffle(own)
        ids, texts, x, y, w, h, bold = map(list, zip(*own))
        got = layout._flat_lines(np.array(ids), texts, *map(np.array, (x, y, w, h, bold)), 612.0)
        if n % 10 == 9:
            assert got is None
        if got is not None:
            taken += 1
            splits.add(got[1] is None)
            assert got == layout.build_lines(own, 612.0)
    assert taken > 100 and splits == {True, False}


def test_blocks_of_pages_without_a_shuffle(spark):
    """Page by page as by items, chrome and all; items of a page stay together from the text to its blocks."""
    from paperloom.plans import registry  # noqa: F401
    from paperloom.plans import layout_queries

    sf = "/root/testdata/sf0.001"
    pages, items = layout_queries.pages(spark, sf), layout_queries.items(spark, sf)
    every = pages.select("doc", "page", F.explode("own").alias("i")).select("doc", "page", "i.*")
    assert every.schema.simpleString() == items.schema.simpleString()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(every) == key(items)
    got = layout.blocks_of_pages(pages)
    assert key(got) == key(layout.blocks(items)) and got.count()
    plan = layout_queries.page_blocks(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning" not in plan
    odd = spark.createDataFrame([(1, 1, []), (1, 2, None), (None, 3, [(7, "word", 100.0, 300.0, 20.0, 10.0, None)])], "doc long, page int, own array<struct<id:long,str:string,x:double,y:double,width:double,height:double,bold:boolean>>")
    assert [tuple(r) for r in layout.blocks_of_pages(odd).collect()] == [(None, 3, 0, "text", "word", 100.0, 300.0, 120.0, 310.0, [7])]


def test_chrome_of_words_and_digits(spark):
    from paperloom.functions import text

    words = "a of c s x 7 12 2019 12345 a1111 a111 111111111 vol12 volume3 no5 north2 issn12345678 nature science1 cell p12 et2019 acl20 nips2017 method 1st arxiv1234 bb".split()
    df = spark.createDataFrame([(w, x, y, h) for w in words for x in (10.0, 300.0, None) for y in (10.0, 50.0, 400.0, 770.0, None) for h in (8.0, 10.0)], "s string, x double, y double, h double")
    item = (F.col("s"), F.col("x"), F.col("y"), F.col("h"), F.lit(792.0), F.lit(612.0))
    own = df.select("s", "x", "y", "h", F.coalesce(text.is_page_chrome_item(*item), F.lit(False)).alias("quick"), F.coalesce(text._is_page_chrome_item(*item), F.lit(False)).alias("full")).collect()
    assert [r for r in own if r["quick"] != r["full"]] == [] and {r["full"] for r in own} == {True, False}
