import pytest
from pyspark.sql import functions as F

from paperloom.operators import store


@pytest.fixture
def notes(spark):
    rows = [
        ("a", "d1", 1, 1, 10, "user", "note", None), ("b", "d1", 2, 2, 5, "ai", "qa", None), ("c", "d1", None, 1, 7, "user", "highlight", 99),
        ("d", "d2", 1, 1, 1, "user", "note", None),
    ]
    return spark.createDataFrame(rows, "id string, docHash string, page int, rev long, updatedAt long, author string, kind string, deletedAt long")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_scan_ranges(notes):
    assert ids(store.scan(notes, ["docHash", "page"], ["id"])) == ["a", "b", "d"]
    assert ids(store.scan(notes, ["docHash", "page"], ["id"], {"equals": ["d1"], "direction": "prev"})) == ["b", "a"]
    assert ids(store.scan(notes, ["docHash", "page"], ["id"], {"from": ["d1", 1], "fromExclusive": True})) == ["b", "d"]
    assert ids(store.scan(notes, ["docHash", "page"], ["id"], {"from": ["d1", 2], "to": ["d2"], "toExclusive": True, "limit": 1})) == ["b"]


@pytest.mark.parametrize("q", [[], {"where": 1}, {"limit": -1}, {"limit": "3"}, {"direction": "up"}])
def test_query_validation(q):
    with pytest.raises(store.DataError):
        store.check_query(q)


def test_merge_ties(spark):
    schema = "id string, rev long, updatedAt long, v string"
    local = spark.createDataFrame([("x", 2, 5, "l"), ("y", 1, 5, "l"), ("z", 1, 5, "l"), ("w", 1, None, "l")], schema)
    incoming = spark.createDataFrame([("x", 1, 9, "i"), ("y", 1, 6, "i"), ("z", 1, 5, "i"), ("n", 1, 1, "i"), (None, 1, 1, "i")], schema)
    got = {r["id"]: r["v"] for r in store.merge(local, incoming.where("id is not null"), ["id"]).collect()}
    assert got == {"x": "l", "y": "i", "z": "l", "w": "l", "n": "i"}
    t = store.tally(store.merge_outcomes(local, incoming, ["id"])).first()
    assert (t["added"], t["updated"], t["skipped"], t["rejected"]) == (1, 1, 2, 1)


def test_changes(spark):
    log = spark.createDataFrame([(k, "put" if k % 3 else "delete", f"k{k % 2}", k, k) for k in range(1, 7)], "seq long, op string, id string, rev long, updatedAt long")
    assert [r["seq"] for r in store.changes_since(log, 2, 2).collect()] == [3, 4]
    rows = spark.createDataFrame([("k0", 9, 0), ("k9", 1, 1)], "id string, rev long, updatedAt long")
    got = {r["id"]: r["rev"] for r in store.apply_changes(rows, log, ["id"]).collect()}
    assert got == {"k0": 9, "k9": 1, "k1": 5}


def test_page_outcomes(spark):
    rows = [("d", 1, 0, "done", False, False), ("d", 1, 1, "failed", False, False), ("d", 2, 2, "partial", False, True), ("d", 3, 3, None, False, True), ("d", 0, 4, "held", False, False), ("d", 0, 5, "done", False, False)]
    df = spark.createDataFrame(rows, "docHash string, page int, ord int, runState string, skipped boolean, any_translation boolean")
    r = store.page_outcomes(df).first()
    assert (r["translated"], r["incomplete"]) == (4, 1)


def test_delete_document_and_restore(spark, notes):
    papers = spark.createDataFrame([("d1", None), ("d2", None)], "docHash string, deletedAt long")
    out, log = store.delete_document({"papers": papers, "notes": notes}, "d1", 50)
    assert {r["docHash"]: r["deletedAt"] for r in out["papers"].collect()} == {"d1": 50, "d2": None}
    assert ids(out["notes"]) == ["d"] and {(r["collection"], r["n"]) for r in log.collect()} == {("papers", 1), ("notes", 3)}
    with pytest.raises(store.DataError):
        store.delete_document({"papers": papers}, "d1", 50, open_hash="d1")
    gone = store.set_deleted(notes, spark.createDataFrame([("a",)], "id string"), 7)
    assert {r["id"]: (r["deletedAt"], r["rev"]) for r in gone.collect()}["a"] == (7, 2)
    assert sorted(ids(store.purge(notes, spark.createDataFrame([("a",)], "id string")))) == ["b", "c", "d"]
    assert ids(store.trash(notes)) == ["c"]


def test_facets_and_notes(notes):
    own = notes.withColumn("anchorState", F.struct(F.lit("ok").alias("status")))
    r = store.facet_counts(own).first()
    assert (r["all"], r["mine"], r["highlight"], r["ai"], r["pending"]) == (4, 3, 1, 1, 0)
    assert sorted(ids(store.notes_of(notes, "d1"))) == ["a", "b"] and ids(store.notes_of(notes, "d1", ["qa"])) == ["b"]


def test_build_paper(spark):
    old = spark.createDataFrame([("d1", "Old", "https://arxiv.org/abs/1706.03762v7", 3, 1, 2, 9)], "docHash string, title string, sourceUrl string, rev long, createdAt long, updatedAt long, deletedAt long")
    patch = spark.createDataFrame([("d1", "New"), ("d2", "Two")], "docHash string, title string")
    got = {r["docHash"]: r for r in store.build_paper(old, patch, 100).collect()}
    assert (got["d1"]["title"], got["d1"]["rev"], got["d1"]["createdAt"], got["d1"]["deletedAt"], got["d1"]["arxivId"]) == ("New", 4, 1, 9, "1706.03762")
    assert (got["d2"]["rev"], got["d2"]["createdAt"]) == (1, 100)
    assert {r["deletedAt"] for r in store.build_paper(old, patch, 100, revive=True).collect()} == {None}


def test_nested_documents_round_trip(spark):
    docs = spark.createDataFrame(
        [("d", " A  title ", [(1, ["p1"], [("m", "x", "L1", 5), ("m", "x", "again", 6)]), (1, ["late"], []), (2, ["p2"], [("", "x", "L2", 1)])])],
        "docHash string, title string, pages array<struct<page:int,pairs:array<string>,layouts:array<struct<mode:string,protocol:string,layout:string,savedAt:long>>>>",
    )
    papers, pages, layouts = store.flatten_document(docs)
    assert papers.first()["title"] == "A title" and sorted((r["page"], r["pairs"]) for r in pages.collect()) == [(1, ["p1"]), (2, ["p2"])]
    assert sorted(r["layout"] for r in layouts.collect()) == ["L1", "L2"]
    back = store.nest_document(papers, pages, layouts, "m").first()
    assert [(p["page"], p["layout"]) for p in back["pages"]] == [(1, "L1"), (2, "L2")]


def test_bundle_strips_secrets(spark, notes):
    papers = spark.createDataFrame([("d1", "T", "sk-1", None)], "docHash string, title string, apiKey string, deletedAt long")
    pages = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a")], "docHash string, page int, runState string")
    text = store.bundle(papers, pages, notes).first()["json"]
    assert "apiKey" not in text and text.index('"page":1') < text.index('"page":2') and '"c"' not in text


def test_save_if_absent_and_storage(spark):
    items = spark.createDataFrame([("a", "b", 1)], "original string, translation string, n int")
    more = spark.createDataFrame([("a", "b", 2), ("c", "d", 3), ("c", "d", 4)], "original string, translation string, n int")
    assert store.save_if_absent(items, more).count() == 2
    a = spark.createDataFrame([("d1", "xx"), ("d2", "y")], "docHash string, v string")
    whole = store.storage({"a": a, "b": a})
    again = store.storage_update(whole, spark.createDataFrame([("d1",)], "docHash string"), {"a": a, "b": a})
    assert sorted(whole.collect()) == sorted(again.collect())
