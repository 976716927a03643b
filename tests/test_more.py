"""Operators whose queries have no SQL, and cases that the tables do not hold."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from paperloom.functions import geometry, text
from paperloom.operators import layout, match, sample, score, store, translate, web


def test_anchors_keep_clear_of_the_last_one():
    assert match.monotone([(0, 0), (1, 50), (4, 4), (8, 8)], 4) == [(4, 4), (8, 8)]
    assert match.monotone([(5, 5), (7, 40), (9, 9), (20, 8), (21, 14)], 4) == [(5, 5), (9, 9), (21, 14)]


def test_alignment_survives_a_stray_anchor():
    a = [f"w{k}" for k in range(60)]
    b = a[:20] + ["x", "y"] + a[20:50] + a[2:6]
    found = dict(match.align_words(a, b))
    assert all(found.get(k) == (k if k < 20 else k + 2) for k in range(8, 50))


def row(*words, gap=60.0):
    out, x = [], 50.0
    for w in words:
        out.append(SimpleNamespace(str=w, x=x, y=1.0, width=5.0 * len(w), height=10.0))
        x += 5.0 * len(w) + gap
    return out


def test_prose_gutters():
    left, right, third = "words of the left column", "words of the right column", "words of the last column"
    assert layout.prose_gutters([row(left, right)] * 3) == [50 + 5 * len(left) + 30]
    three = layout.prose_gutters([row(left, right, third)] * 4)
    assert len(three) == 2 and three[0] < three[1]
    assert layout.prose_gutters([row(left, right)]) == []  # one vote is none
    assert layout.prose_gutters([row("x = 1", "(3)")] * 5) == []  # equations do not vote
    assert layout.prose_gutters([row("Residual Dropout", "We apply dropout to the output")] * 5) == []  # a heading before its paragraph
    assert layout.prose_gutters([row(left, right, gap=4.0)] * 5) == []


def test_columns_are_measured_by_what_the_items_span():
    narrow = [SimpleNamespace(str="a" * 20, x=x, y=700.0 - 14 * k, width=80.0, height=10.0) for k in range(4) for x in (100.0, 200.0)]
    assert layout.column_split(narrow) == 190.0
    assert layout.column_split(narrow[:4]) is None


def test_sanitizer():
    assert web.sanitized('<p onclick="x()">a<br>b</p>') == "<p>a<br>b</p>"
    assert web.sanitized('<a href="javascript:alert(1)" title="t">x</a>') == '<a title="t">x</a>'
    assert web.sanitized('<a href="https://e.org/?a=1&amp;b=2">x</a>') == '<a href="https://e.org/?a=1&amp;b=2">x</a>'
    assert web.sanitized("<script>alert(1)</script>").startswith("&lt;script&gt;")
    assert web.sanitized('<code class="language-py">1 &lt; 2</code><code class="x y">z</code>') == '<code class="language-py">1 &lt; 2</code><code>z</code>'
    assert web.sanitized("a < b <never closed") in ("a &lt; b &lt;never closed", "a &lt; b ")
    assert web.sanitized(None) == ""


def test_path_points():
    points, unread = geometry.path_points("M1 2 3 4H9V-1C1 1 2 2 3 3Q0 0 5 5A1 1 0 0 1 9 9Z")
    assert points[:4] == [(1, 2), (3, 4), (9, 4), (9, -1)] and points[-1] == (5, 5) and unread == 1
    assert geometry.path_points("") == ([], 0)


def test_import_goes_on_where_it_stopped(spark):
    own = spark.createDataFrame([(f"d{k // 3}", k) for k in range(21)], "docHash string, page int")
    seen, cursor = [], None
    for _ in range(20):
        batch, at = store.import_next(own, cursor, 3)
        rows = batch.collect()
        if not rows:
            break
        seen += [r["page"] for r in rows]
        cursor = at.first()["cursor"]
    assert sorted(seen) == list(range(21)) and cursor == "d6"


def test_put_with_predicate_and_combination(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (4, "no")], "id int, v string")
    join = lambda old, more: more.join(old.withColumnRenamed("v", "w"), "id", "left").select("id", F.concat_ws("+", "w", "v").alias("v"))
    got = {r["id"]: r["v"] for r in store.put(rows, new, ["id"], accept=F.col("v") != "no", combine=join).collect()}
    assert got == {1: "a", 2: "b+c", 3: "d"}


def test_ranks_equal_a_plain_window(spark):
    rows = [("g" if k % 3 else "h", (k * 7) % 50 / 10 if k % 11 else None, k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, c double, k int")
    got = {r["k"]: r["n"] for r in sample.ranked(df, ["g"], ["c", "k"], "n").collect()}
    for g in "gh":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1], r[2]) if r[1] is not None else (False, 0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


def test_results_do_not_depend_on_the_order_of_rows(spark):
    pairs = [("b1", "s", "x", "t2"), ("b1", "s", "x", "t1"), ("b1", "s", "y", "t0")]
    units = spark.createDataFrame([("b1", "s", "x")], "bid string, sourceId string, text string")
    got = set()
    for own in (pairs, pairs[::-1]):
        df = spark.createDataFrame(own, "bid string, sourceId string, text string, translation string").repartition(2)
        got.add(tuple(translate.reuse(units, df).select("how", "reused").first()))
    assert len(got) == 1


def test_markdown_table_is_bounded(spark):
    assert score.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"
    with pytest.raises(ValueError):
        score.markdown_table(spark.range(5), most=4)


def test_sentence_distance_against_brute_force(spark):
    def far(a, b):
        a, b = " ".join(a.split()).lower(), " ".join(b.split()).lower()
        if a == b or not a or not b:
            return float(a != b)
        x, y, line = a[:400], b[:400], list(range(len(b[:400]) + 1))
        for i, c in enumerate(x, 1):
            last, line[0] = line[0], i
            for j, d in enumerate(y, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (c != d))
        return line[-1] / max(len(a), len(b))

    texts = ["", "Größe und  Maß", "größe und maß", "éèê à la carte", "plain words", "中文 words", "x" * 500, "y" + "x" * 450]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in df.select("a", "b", match.sentence_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert abs(r["d"] - far(r["a"], r["b"])) < 1e-12


def test_text_oddities(spark):
    df = spark.createDataFrame([(["B ", "a", None, "b", "", "A", "c"],)], "l array<string>")
    assert df.select(text.unique_keep_order(F.col("l"))).first()[0] == ["B", "a", "c"]
    one = spark.createDataFrame([("x",)], "v string")
    get = lambda c: one.select(c.alias("c")).first()["c"]
    assert get(text.fill_template(F.lit("{{a}}{b}{{ c }}{{a}}"), {"a": F.lit(1)})) == "1{b}{{ c }}1"
    assert get(text.layout_key(F.lit("pdf-layout:a:b:3:auto:mm:source-v3")))[:4] == ("a:b", 3, "auto", "mm")
    assert get(text.layout_key(F.lit("pdf-layout:a:0:auto:mm:source-v3"))) is None
    assert get(text.latex_charset(F.lit(r"\sin x \foo")))["unknown"] == ["\\foo"]


def test_providers():
    assert translate.provider("stub")(["a"]) == translate.stub(["a"])
    with pytest.raises(KeyError):
        translate.provider("none")


def test_queue_keeps_rows_without_groups(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(k, [None, "en", "de"][k % 3], [None, "a", "b"][k % 4 % 3], None if k % 5 == 0 else k % 7) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()["interleaved_queue"](spark, str(tmp_path)).select("doc_id", "round", "lang").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(entry.oracle_sql()["interleaved_queue"]).select("doc_id, round, lang").fetchall())


def test_ranks_of_odd_numbers(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(g, v, k) for g, own in {"a": [1.0, inf, -inf, nan, 2.0], "b": [5.0, 5.0], "c": [1e308, -1e308, 0.0], "d": [1.0, 1.5, 1e9, 1.25]}.items() for k, v in enumerate(own)]
    got = {(r["g"], r["k"]): r["n"] for r in sample.ranked(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], ["v", "k"], "n").collect()}
    for g in "abcd":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] != r[1], r[1] if r[1] == r[1] else 0, r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))
