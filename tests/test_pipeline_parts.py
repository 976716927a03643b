"""Translation, events, web pages, sources, sinks and streams."""

import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import events, score, translate, web
from paperloom.sources import files, sinks
from paperloom.streaming import events as streams


def test_translation_run_asks_the_model_once(spark):
    units = spark.createDataFrame([(1, 1, "b1", "s1", "Hello there"), (1, 1, "b2", "s2", "Hello  there"), (1, 2, "b3", "s3", "Saved text"), (1, 2, "b4", "s4", "Changed")], "doc int, page int, bid string, sourceId string, text string")
    pairs = spark.createDataFrame([("b3", "s3", "Saved text", "存"), ("b4", "s4", "Old source", "旧")], "bid string, sourceId string, text string, translation string")
    rows = {r["bid"]: (r["how"], r["translation"]) for r in translate.run(units, pairs).collect()}
    assert rows == {"b1": ("model", "译：Hello there"), "b2": ("model", "译：Hello there"), "b3": ("bid", "存"), "b4": ("model", "译：Changed")}

    def broken(x):
        raise RuntimeError

    rows = {r["bid"]: r["translation"] for r in translate.run(units, pairs, polish=broken).collect()}
    assert rows["b1"] == "译：Hello there"


def test_paint_and_merge(spark):
    blocks = spark.createDataFrame([("b1", "i1", "text", "t", False, "old"), ("", "i2", "text", "t", False, None), ("b3", "i3", "formula", "t", False, None)], "bid string, id string, label string, text string, skip boolean, translation string")
    res = spark.createDataFrame([("b1", "", "", False), ("", "i2", "新", False), ("b3", "", "x", False)], "bid string, id string, translation string, failed boolean")
    assert {r["id"]: r["translation"] for r in translate.paint(blocks, res).collect()} == {"i1": "old", "i2": "新", "i3": None}
    prior = spark.createDataFrame([(1, 1, "a", "s", "译"), (1, 1, "b", "s", "")], "doc int, page int, bid string, text string, translation string")
    new = spark.createDataFrame([(1, 1, "a", "s", "改"), (1, 1, "b", "s", "新"), (1, 1, "c", "s", "加"), (1, 1, "", "s", "掉")], "doc int, page int, bid string, text string, translation string")
    assert {r["bid"]: r["translation"] for r in translate.merge_rows(prior, new).collect()} == {"a": "译", "b": "新", "c": "加"}
    ask = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "req int, pos int, bid string")
    got = spark.createDataFrame([(1, 0, "y", "Y"), (1, 1, "y", "late"), (1, 0, None, "by place")], "req int, pos int, bid string, translation string")
    assert {r["bid"]: r["translation"] for r in translate.pair_responses(ask, got).collect()} == {"x": "by place", "y": "Y"}


def test_page_state(spark):
    rows = [(1, "text one two three", "译"), (2, "text one two three", ""), (3, "text one two three", "译"), (3, "text one two three", ""), (4, None, None)]
    df = spark.createDataFrame(rows, "page int, text string, translation string")
    assert {r["page"]: r["state"] for r in translate.page_state(df, ["page"]).collect()} == {1: "done", 2: "failed", 3: "partial", 4: "empty"}


def test_retention_edges(spark):
    now, week = 10**12, events.RETENTION_MS
    df = spark.createDataFrame([(now - week, 10), (now - week - 1, 10), (now + 60_000, 10), (now + 60_001, 10), (now, 10)], "t long, n int")
    keep = lambda cap: sorted(r["t"] for r in events.retain(df, now, F.col("n"), cap=cap).collect())
    assert keep(1000) == [now - week, now, now + 60_000]
    assert keep(10 * 2 + 3) == [now, now + 60_000] and keep(10 * 2 + 2) == [now + 60_000] and keep(5) == []


def test_commit_guards():
    w = lambda **k: dict(key="k", value="v", verified=True, epoch=1, writer="w", serial=1, at=1) | k
    row, chain, how = events.commit(None, [], w())
    assert how == "kept"
    assert events.commit(row, chain, w(verified=False))[2] == "downgrade" and events.commit(row, chain, w(epoch=0))[2] == "epoch"
    assert events.commit(row, chain, w(serial=0))[2] == "serial" and events.commit(row, chain, w(at=0))[2] == "late"
    for k in range(2, 12):
        row, chain, how = events.commit(row, chain, w(serial=k, at=k, value=str(k)))
    assert how == "full" and len(chain) == events.CHAIN and row["value"] == "9"
    assert events.rollback(row, chain, "w")[0]["value"] == "8" and events.rollback(row, chain, "x")[0] == row


def test_clean_events(spark):
    df = spark.createDataFrame([(1, "ok.type", "c", "see https://u:p@h.org/p?x sk-12345 topsecret", "m/1", 3, "dropped"), (2, "bad type!", "c", "", "m", 1, "x")], "t long, type string, code string, msg string, model string, page int, extra string")
    r = events.clean(df, ["topsecret"]).collect()
    assert len(r) == 1 and r[0]["msg"] == "see https://h.org *** ***" and "extra" not in r[0].asDict()


HTML = """<html><head><title>Real Heading - Site</title></head><body><nav><ul><li>Home</li></ul></nav><main><h1>Real Heading</h1>
<p>One <b>bold</b> line.</p><div class="sidebar"><p>chrome text</p></div><ul><li>Item<p>nested one</p></li></ul><pre><p>code</p></pre><p>12 / 34</p></main><footer><p>Foot words</p></footer></body></html>"""


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>open <p>unclosed")], "page_id long, html string")
    rows = web.html_blocks(df)
    got = [(r["tag"], r["region"], r["text"]) for r in rows.where("page_id = 1").orderBy("ord").collect()]
    assert ("h1", 0, "Real Heading") in got and ("p", 0, "One bold line.") in got and ("p", 2, "Foot words") in got
    assert not any(t in ("chrome text", "code", "12 / 34") for *_, t in got)
    assert web.primary_title(rows).first()["primary"] == "Real Heading"
    kept = [r["text"] for r in web.limit_blocks(rows.where("page_id = 1"), "preview").orderBy("ord").collect()]
    assert len(kept) == 2 and "Real Heading" in kept
    assert web.limit_blocks(rows.where("page_id = 1"), 2).count() == 2


def archive():
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for name, data in (("main.tex", b"\\documentclass{a}\\begin{document}\\section{One}Text here.\n\n\\input{part}\\end{document}"), ("part.tex", b"\\begin{align}a&=b\\\\c&=d\\notag\\\\e&=f\\end{align}"), ("../evil", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_archives_and_latex(spark):
    df = spark.createDataFrame([("p", bytearray(archive())), ("q", bytearray(b"%PDF-1.4")), ("r", bytearray(b"\\section{x}"))], "id string, content binary")
    rows = {(r["id"], r["path"]): r["problem"] for r in files.archives(df).collect()}
    assert rows == {("p", "main.tex"): "", ("p", "part.tex"): "", ("p", "../evil"): "unsafe", ("q", ""): "pdf", ("r", "main.tex"): ""}
    src = files.archives(df).where("id = 'p' and problem = ''").select(F.col("id").alias("paper"), "path", F.decode("content", "UTF-8").alias("text"))
    units = [(r["kind"], r["number"], r["text"] or r["latex"]) for r in files.parse_latex(src).orderBy("ord").collect()]
    assert units == [("heading", "1", "One"), ("text", None, "Text here."), ("display", "1", "a&=b"), ("display", None, "c&=d"), ("display", "2", "e&=f")]
    assert files.expand_macros(r"\newcommand{\v}[1]{\mathbf{#1}} \v{x}").endswith(r"\mathbf{x}")


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("text")
    (tmp_path / "b.bin").write_bytes(b"x")
    assert [r["text"] for r in files.plain_texts(spark, str(tmp_path)).collect()] == ["text"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.json").write_text(json.dumps({"paperId": "p", "page": 1, "units": [{"id": "u", "type": "inline", "elementIds": ["e"], "confidence": 0.5}]}))
    (tmp_path / "l" / "2.json").write_text("{broken")
    pages = files.label_pages(spark, str(tmp_path / "l")).cache()
    man = spark.createDataFrame([("p", "ai", "pre")], "id string, field string, sourceType string")
    assert pages.where("_corrupt is not null").count() == 1 and files.units_of(pages, man).first()["field"] == "ai"
    f = spark.createDataFrame([("a", bytearray(b"%PDF-x")), ("b", bytearray(b"<html>Just a moment")), ("d", bytearray(b"%PDF-y"))], "id string, content binary")
    m = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", "00")], "id string, sha256 string")
    assert {r["id"]: r["status"] for r in files.verified_ingest(m, f).collect()} == {"a": "ok", "b": "challenge", "c": "missing", "d": "mismatch"}
    ls = spark.createDataFrame([("/r/x/paper.json", 5), ("/r/x/page-1.json", 5), ("/r/y/page-2.json", 5), ("/r/z/other", 5)], "path string, length long")
    assert {r["dir"]: r["kind"] for r in files.classify_folders(ls).collect()} == {"/r/x": "library", "/r/y": "partial", "/r/z": "unrelated"}


def test_layout_payloads(spark):
    env = {"vendor": "v", "page": 1, "pixelWidth": 100, "pixelHeight": 200, "layoutDetails": [{"label": "image", "bbox_2d": [0, 0, 50, 100]}, {"label": "figure_title", "bbox_2d": [0, 100, 50, 120], "content": "Fig"}]}
    rows = files.vendor_blocks(spark.createDataFrame([("d", json.dumps(env))], "doc string, json string")).orderBy("ord").collect()
    assert [(r["label"], r["figure"]) for r in rows] == [("figure", None), ("caption", "v0")] and rows[0]["box"]["y1"] == 0.5
    good = "```json\n" + json.dumps({"columns": 1, "blocks": [{"id": "b", "order": 7}, {"id": "a", "order": 3}]}) + "\n```"
    bad = json.dumps({"blocks": [{"id": "b", "order": 1}, {"id": "a", "order": 1}]})
    blocks, refused = files.model_blocks(spark.createDataFrame([("d", 1, good), ("d", 2, bad), ("d", 3, "no")], "doc string, page int, json string"))
    assert [(r["ord"], r["id"]) for r in blocks.orderBy("ord").collect()] == [(1, "a"), (2, "b")] and sorted(r["page"] for r in refused.collect()) == [2, 3]
    pages, rejects = files.legacy_pages(spark.createDataFrame([("d", '{"page": 1, "runState": "done"}'), ("d", "{"), ("d", '{"page": 0}')], "docHash string, json string"))
    assert pages.count() == 1 and rejects.count() == 2


def test_sinks(spark):
    df = spark.createDataFrame([("d", 1, "p", "Para"), ("d", 0, "h2", "Head"), ("d", 2, "li", "item")], "doc string, ord int, tag string, text string")
    assert sinks.article_markdown(df).first()["markdown"] == "## Head\n\nPara\n\n- item"
    pairs = spark.createDataFrame([("d", 0, "a<b", "译&")], "doc string, ord int, text string, translation string")
    assert "<p>a&lt;b</p><p>译&amp;</p>" in sinks.bilingual_html(pairs).first()["html"]
    assert score.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_scores(spark):
    goldens = [("a", "ai", "pre", 135, 16), ("b", "ai", "pub", 228, 10), ("c", "math", "pub", 221, 5)]
    df = spark.createDataFrame([(i, f, s, 1, u, c, 0.5) for i, f, s, u, c in goldens], "id string, field string, sourceType string, pages long, units long, correct long, jaccard double")
    got = {(r["grouped_by"], r["value"]): r["exact"] for r in score.grouped_scores(score.paper_scores(df)).collect()}
    assert got == {("field", "ai"): 0.072, ("field", "math"): 0.023, ("sourceType", "pre"): 0.119, ("sourceType", "pub"): 0.033}
    images = spark.createDataFrame([(1, 2, 2, bytearray([0, 255, 255, 255]), bytearray([255, 0, 255, 255]))], "id long, width int, height int, own binary, truth binary")
    r = score.ink(images).first()
    assert (r["missing"], r["extra"], r["max_diff"], r["n_diff"]) == (1, 1, 255, 2)


def wait(q):
    q.processAllAvailable()
    q.stop()


def test_change_stream(spark, tmp_path):
    schema = "seq long, op string, id string, rev long, updatedAt long"
    src, root, cp = (str(tmp_path / n) for n in ("src", "root", "cp"))
    spark.createDataFrame([(1, "put", "a", 1, 1), (2, "delete", "a", 9, 9)], schema).write.parquet(src)
    state = "id string, rev long, updatedAt long"
    run = lambda: streams.apply_changes(streams.read_changes(spark, src, schema), root, ["id"], state, cp).start()
    wait(run())
    spark.createDataFrame([(3, "put", "a", 3, 1), (4, "put", "b", 1, 1), (5, "put", "a", 2, 8)], schema).write.mode("append").parquet(src)
    wait(run())
    assert {r["id"]: r["rev"] for r in streams.latest(spark, root, state).collect()} == {"a": 3, "b": 1}


def test_log_stream(spark, tmp_path):
    schema = "t long, type string, code string, msg string, model string"
    src, root, cp = (str(tmp_path / n) for n in ("src", "root", "cp"))
    now = int(time.time() * 1000)
    spark.createDataFrame([(now, "a", "", "sk-1", ""), (now - events.RETENTION_MS - 5, "old", "", "", ""), (now + 120_000, "late", "", "", "")], schema).write.parquet(src)
    wait(streams.keep_log(spark.readStream.schema(schema).parquet(src), root, cp, lambda: now).start())
    rows = streams.latest(spark, root, spark.read.parquet(root).drop("v").schema).collect()
    assert [(r["type"], r["msg"]) for r in rows] == [("a", "***")]


@pytest.mark.parametrize("kind", ["captions", "commits"])
def test_stateful_streams(spark, tmp_path, kind):
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    if kind == "captions":
        schema = "tab long, t long, text string"
        spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a")], schema).coalesce(1).write.parquet(src)
        out = streams.changed_lines(spark.readStream.schema(schema).parquet(src))
    else:
        schema = "key string, seq long, value string, verified boolean, epoch long, writer string, serial long, at long"
        spark.createDataFrame([("k", 1, "x", True, 1, "w", 1, 1), ("k", 2, "y", False, 1, "w", 2, 2)], schema).coalesce(1).write.parquet(src)
        out = streams.guarded_commits(spark.readStream.schema(schema).parquet(src))
    wait(out.writeStream.format("memory").queryName(kind).option("checkpointLocation", cp).outputMode("append").start())
    rows = sorted(tuple(r) for r in spark.sql(f"select * from {kind}").collect())
    assert rows == ([(1, 1, "a"), (1, 3, "b"), (2, 1, "a")] if kind == "captions" else [("k", 1, "kept", "x"), ("k", 2, "downgrade", "x")])
