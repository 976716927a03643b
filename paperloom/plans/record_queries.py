"""Queries on records, notes, translations, labels and formulas: orders, customers and labels stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import events, layout, match, score, store, translate, web
from .document_queries import BLOCKS, blocks, sql_collapse
from .registry import query, table

# --- papers, pages, notes -------------------------------------------------------------------------

_PAPERS = "papers AS (SELECT c_custkey AS docHash, '  ' || c_mktsegment || '  no ' || c_nationkey || ' ' AS title, CASE WHEN c_custkey % 7 = 0 THEN 99 END AS deletedAt, c_nationkey AS lastOpenedAt FROM customer)"
_NOTES = """notes AS (SELECT o_orderkey AS id, o_custkey % 60 AS docHash, o_orderkey % 9 AS page, CASE o_orderstatus WHEN 'F' THEN 'highlight' WHEN 'O' THEN 'qa' ELSE 'note' END AS kind,
  1 + o_orderkey % 4 AS rev, o_orderkey % 100 AS createdAt, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey END AS deletedAt, CASE o_orderkey % 5 WHEN 0 THEN 'lost' WHEN 1 THEN 'pending' ELSE 'ok' END AS status FROM orders)"""


def _papers(spark, sf_dir):
    title = F.concat(F.lit("  "), "c_mktsegment", F.lit("  no "), F.col("c_nationkey").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("docHash"), title.alias("title"), F.when(F.col("c_custkey") % 7 == 0, 99).alias("deletedAt"),
        F.col("c_nationkey").alias("lastOpenedAt"), F.lit(None).cast("string").alias("sourceUrl"),
    )


def _notes(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "highlight").when(F.col("o_orderstatus") == "O", "qa").otherwise("note")
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "lost").when(k % 5 == 1, "pending").otherwise("ok")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 60).alias("docHash"), (k % 9).alias("page"), kind.alias("kind"), (1 + k % 4).alias("rev"), (k % 100).alias("createdAt"),
        F.when(k % 11 == 0, k).alias("deletedAt"), F.struct(status.alias("status")).alias("anchorState"), status.alias("status"),
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77 AND o_orderstatus = (SELECT o_orderstatus FROM orders WHERE o_orderkey = 77)")
def point_read(spark, sf_dir):
    return store.get(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], [77])


@query(f"WITH {_PAPERS} SELECT docHash, lastOpenedAt, deletedAt, {sql_collapse('title')} AS title, '' AS sourceUrl FROM papers")
def paper_summary(spark, sf_dir):
    return store.summary(_papers(spark, sf_dir))


@query(f"WITH {_PAPERS} SELECT docHash, lastOpenedAt FROM papers WHERE deletedAt IS NULL AND docHash <> 5 ORDER BY lastOpenedAt DESC, docHash LIMIT 15")
def recent_papers(spark, sf_dir):
    return store.recent_papers(_papers(spark, sf_dir), 5).select("docHash", "lastOpenedAt")


@query(f"WITH {_NOTES} SELECT id, docHash FROM notes WHERE docHash = 7 AND kind IN ('note', 'qa') AND deletedAt IS NULL")
def notes_of_document(spark, sf_dir):
    return store.notes_of(_notes(spark, sf_dir), 7, ["note", "qa"]).select("id", "docHash")


@query(f"WITH {_NOTES} SELECT id, docHash, deletedAt FROM notes WHERE deletedAt IS NOT NULL")
def notes_trash(spark, sf_dir):
    return store.trash(_notes(spark, sf_dir)).select("id", "docHash", "deletedAt")


@query(f"WITH {_NOTES} SELECT id, docHash, CASE WHEN status = 'lost' THEN 'lost' ELSE 'placed' END AS list FROM notes WHERE deletedAt IS NULL")
def notes_by_place(spark, sf_dir):
    return store.notes_by_place(_notes(spark, sf_dir)).select("id", "docHash", "list")


@query(f"WITH {_NOTES} SELECT docHash, count(*) FILTER (WHERE deletedAt IS NULL) AS notesCount FROM notes GROUP BY docHash")
def notes_per_document(spark, sf_dir):
    return store.touch_documents(_notes(spark, sf_dir))


@query(f"WITH {_NOTES} SELECT id, rev FROM notes WHERE rev > 2")
def notes_since_revision(spark, sf_dir):
    return store.notes_since(_notes(spark, sf_dir), 2).select("id", "rev")


@query(
    f"""WITH {_NOTES} SELECT id, docHash, row_number() OVER (PARTITION BY docHash ORDER BY status = 'lost', page, createdAt, id) AS place FROM notes"""
)
def notes_in_order(spark, sf_dir):
    from pyspark.sql import Window

    own = _notes(spark, sf_dir).withColumn("block_ord", F.col("page")).withColumn("anchor", F.struct(F.struct(F.lit(0).alias("start")).alias("offset")))
    ordered = store.order_notes(own).withColumn("n", F.monotonically_increasing_id())  # grows along the sort
    return ordered.select("id", "docHash", F.row_number().over(Window.partitionBy("docHash").orderBy("n")).cast("long").alias("place"))


@query(
    f"""WITH {_NOTES} SELECT id, CASE WHEN docHash % 3 = 0 THEN 500 ELSE deletedAt END AS deletedAt, rev + CASE WHEN docHash % 3 = 0 THEN 1 ELSE 0 END AS rev FROM notes WHERE id % 13 <> 0"""
)
def notes_deleted_and_purged(spark, sf_dir):
    own = _notes(spark, sf_dir)
    marked = store.set_deleted(own, own.where("docHash % 3 = 0").select("id"), 500)
    return store.purge(marked, own.where("id % 13 = 0")).select("id", "deletedAt", "rev")


@query(
    f"""WITH {_NOTES}, r AS (SELECT docHash, id % 20 AS bid, kind, row_number() OVER (PARTITION BY docHash, id % 20 ORDER BY CASE kind WHEN 'qa' THEN 3 WHEN 'note' THEN 2 ELSE -1 END DESC, id DESC) AS k,
           count(*) OVER (PARTITION BY docHash, id % 20) AS n FROM notes WHERE deletedAt IS NULL)
    SELECT docHash, bid, kind, CASE WHEN n >= 2 THEN n END AS count FROM r WHERE k = 1"""
)
def note_pins(spark, sf_dir):
    return store.pin(_notes(spark, sf_dir).withColumn("bid", F.col("id") % 20), {"qa": 3, "note": 2})


@query(
    """WITH i AS (SELECT o_orderpriority AS original, o_orderstatus AS translation FROM orders WHERE o_orderkey % 9 = 0), m AS (SELECT DISTINCT o_orderpriority AS original, o_orderstatus || o_orderkey % 4 AS translation FROM orders
    UNION SELECT o_orderpriority, o_orderstatus FROM orders)
    SELECT * FROM i UNION ALL SELECT * FROM m WHERE (original, translation) NOT IN (SELECT (original, translation) FROM i)"""
)
def save_if_absent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("original"), F.col("o_orderstatus").alias("translation"), "o_orderkey")
    more = o.select("original", F.concat("translation", (F.col("o_orderkey") % 4).cast("string")).alias("translation")).unionByName(o.select("original", "translation"))
    return store.save_if_absent(o.where("o_orderkey % 9 = 0").select("original", "translation"), more)


@query(
    """WITH a AS (SELECT o_custkey AS docHash, o_orderkey AS page, o_orderstatus AS state FROM orders), b AS (SELECT c_custkey AS docHash, c_mktsegment AS title FROM customer),
    s AS (SELECT docHash, length('{"docHash":' || docHash || ',"page":' || page || ',"state":"' || state || '"}') AS n FROM a UNION ALL SELECT docHash, length('{"docHash":' || docHash || ',"title":"' || title || '"}') FROM b)
    SELECT docHash, sum(n)::BIGINT AS bytes, count(*) AS records FROM s GROUP BY docHash"""
)
def storage_by_document(spark, sf_dir):
    return store.storage(_collections(spark, sf_dir))


def _collections(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return {
        "pages": o.select(F.col("o_custkey").alias("docHash"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("state")),
        "papers": c.select(F.col("c_custkey").alias("docHash"), F.col("c_mktsegment").alias("title")),
    }


@query(
    """WITH a AS (SELECT o_custkey AS docHash, o_orderkey AS page, o_orderstatus AS state FROM orders WHERE o_custkey % 4 = 0), b AS (SELECT c_custkey AS docHash, c_mktsegment AS title FROM customer),
    s AS (SELECT docHash, length('{"docHash":' || docHash || ',"page":' || page || ',"state":"' || state || '"}') AS n FROM a UNION ALL SELECT docHash, length('{"docHash":' || docHash || ',"title":"' || title || '"}') FROM b WHERE docHash % 4 = 0)
    SELECT docHash, sum(n)::BIGINT AS bytes, count(*) AS records FROM s GROUP BY docHash UNION ALL SELECT c_custkey, 1, 1 FROM customer WHERE c_custkey % 4 <> 0"""
)
def storage_of_dirty_documents(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docHash"), F.lit(1).cast("long").alias("bytes"), F.lit(1).cast("long").alias("records"))
    return store.storage_update(known, known.where("docHash % 4 = 0").select("docHash"), _collections(spark, sf_dir))


@query(
    """WITH e AS (SELECT c_custkey AS docHash, c_mktsegment AS title, 1 + c_custkey % 3 AS rev, c_custkey AS createdAt, c_custkey AS updatedAt, CASE WHEN c_custkey % 6 = 0 THEN 9 END AS deletedAt FROM customer WHERE c_custkey % 5 <> 0),
    p AS (SELECT c_custkey AS docHash, CASE WHEN c_custkey % 4 = 0 THEN 'new title' END AS title FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(e.docHash, p.docHash) AS docHash, coalesce(p.title, e.title) AS title, CASE WHEN p.docHash IS NOT NULL THEN coalesce(e.rev, 0) + 1 ELSE e.rev END AS rev, coalesce(e.createdAt, 1000) AS createdAt,
           CASE WHEN p.docHash IS NOT NULL THEN 1000 ELSE e.updatedAt END AS updatedAt, e.deletedAt FROM e FULL JOIN p ON e.docHash = p.docHash"""
)
def paper_upsert(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    e = c.where("c_custkey % 5 <> 0").select(
        k.alias("docHash"), F.col("c_mktsegment").alias("title"), (1 + k % 3).alias("rev"), k.alias("createdAt"), k.alias("updatedAt"), F.when(k % 6 == 0, 9).alias("deletedAt")
    )
    p = c.where("c_custkey % 2 = 0").select(k.alias("docHash"), F.when(k % 4 == 0, "new title").alias("title"))
    return store.build_paper(e, p, 1000)


_STATES = "CASE o_orderkey % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' WHEN 3 THEN 'skipped' WHEN 4 THEN 'odd' WHEN 5 THEN 'held' END"


def _pages(spark, sf_dir):
    k = F.col("o_orderkey")
    state = F.expr(_STATES)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("docHash"), k.alias("page"), k.alias("ord"), state.alias("runState"), F.lit(False).alias("skipped"), (k % 2 == 0).alias("any_translation")
    )


@query(f"SELECT o_custkey AS docHash, o_orderkey AS page, runState FROM (SELECT *, {_STATES} AS runState FROM orders) WHERE runState IS NULL OR runState <> 'odd'")
def pages_with_known_state(spark, sf_dir):
    return store.valid_pages(_pages(spark, sf_dir)).select("docHash", "page", "runState")


@query(f"SELECT o_custkey AS docHash, o_orderkey AS page FROM orders WHERE o_custkey <> 10")
def translations_cleared(spark, sf_dir):
    return store.clear_translations(_pages(spark, sf_dir), 10).select("docHash", "page")


@query("SELECT 'pages' AS collection, 10 AS docHash, 'delete' AS op, count(*) AS n, 77 AS at FROM orders WHERE o_custkey = 10 HAVING count(*) > 0 UNION ALL SELECT 'papers', 10, 'delete', count(*), 77 FROM customer WHERE c_custkey = 10 HAVING count(*) > 0")
def document_deletion(spark, sf_dir):
    _, log = store.delete_document({"pages": _pages(spark, sf_dir), "papers": _papers(spark, sf_dir)}, 10, 77)
    return log


@query(
    f"""WITH p AS (SELECT o_custkey AS docHash, {_STATES} AS s, o_orderkey % 2 = 0 AS any_t FROM orders WHERE o_orderkey >= 1 UNION ALL SELECT o_custkey, {_STATES}, o_orderkey % 2 = 0 FROM orders WHERE o_orderkey < 1),
    c AS (SELECT docHash, count(*) FILTER (WHERE s IN ('done', 'skipped', 'held') OR (s IS NULL AND any_t)) AS t, count(*) FILTER (WHERE s IN ('failed', 'partial')) AS i FROM p GROUP BY docHash)
    SELECT c_custkey AS docHash, coalesce(t, 0) AS pagesTranslated, coalesce(i, 0) AS pagesIncomplete, '' AS sourceUrl FROM customer LEFT JOIN c ON c_custkey = docHash WHERE coalesce(t, 0) <> c_custkey % 3"""
)
def papers_repaired(spark, sf_dir):
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docHash"), (F.col("c_custkey") % 3).alias("pagesTranslated"), F.lit(0).alias("pagesIncomplete"), F.lit("").alias("sourceUrl"))
    return store.repair_papers(papers, _pages(spark, sf_dir))


def _nested(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lay = F.array(F.struct(F.col("o_orderstatus").alias("mode"), F.lit("p").alias("protocol"), k.alias("savedAt")), F.struct(F.col("o_orderstatus").alias("mode"), F.lit("p").alias("protocol"), (k + 1).alias("savedAt")))
    page = F.struct(k.alias("ord"), (k % 5).alias("page"), F.array(F.col("o_orderpriority")).alias("pairs"), lay.alias("layouts"))
    docs = o.groupBy((F.col("o_custkey") % 90).alias("docHash")).agg(F.array_sort(F.collect_list(page)).alias("pages"), F.lit(" a  title ").alias("title"))
    return docs.withColumn("pages", F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["pairs"].alias("pairs"), p["layouts"].alias("layouts"))))


@query("SELECT docHash, page, pairs FROM (SELECT o_custkey % 90 AS docHash, o_orderkey % 5 AS page, [o_orderpriority] AS pairs, row_number() OVER (PARTITION BY o_custkey % 90, o_orderkey % 5 ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def document_pages_flat(spark, sf_dir):
    return store.flatten_document(_nested(spark, sf_dir))[1]


@query("SELECT docHash, page, mode, protocol, savedAt FROM (SELECT o_custkey % 90 AS docHash, o_orderkey % 5 AS page, o_orderstatus AS mode, 'p' AS protocol, o_orderkey AS savedAt, row_number() OVER (PARTITION BY o_custkey % 90, o_orderkey % 5, o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def document_layouts_flat(spark, sf_dir):
    return store.flatten_document(_nested(spark, sf_dir))[2]


@query(
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY docHash, page ORDER BY CASE mode WHEN 'O' THEN 0 WHEN '' THEN 1 ELSE 2 END, savedAt DESC) AS k FROM (
      SELECT o_custkey % 90 AS docHash, o_orderkey % 5 AS page, o_orderstatus AS mode, o_orderkey AS savedAt, 'L' || o_orderkey AS layout FROM orders))
    SELECT docHash, count(*)::INTEGER AS pages, string_agg(page || '=' || layout, ',' ORDER BY page) AS layouts FROM l WHERE k = 1 GROUP BY docHash"""
)
def documents_nested(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    own = o.select((F.col("o_custkey") % 90).alias("docHash"), (k % 5).alias("page"), F.col("o_orderstatus").alias("mode"), F.lit("p").alias("protocol"), k.alias("savedAt"), F.concat(F.lit("L"), k.cast("string")).alias("layout"))
    pages = own.select("docHash", "page", F.lit("x").alias("pairs")).distinct()
    nested = store.nest_document(pages.select("docHash").distinct(), pages, own, "O")
    return nested.select("docHash", F.size("pages").alias("pages"), F.array_join(F.transform("pages", lambda p: F.concat(p["page"].cast("string"), F.lit("="), p["layout"])), ",").alias("layouts"))


@query(
    """WITH l AS (SELECT o_orderkey AS docHash, 'new' || o_orderkey AS layout FROM orders WHERE o_orderkey % 3 = 0), g AS (SELECT o_orderkey AS docHash, 'old' || o_orderkey AS layout FROM orders WHERE o_orderkey % 2 = 0)
    SELECT o_orderkey AS docHash, 1 AS page, 'm' AS mode, 'p' AS protocol, coalesce(l.layout, g.layout) AS layout FROM orders LEFT JOIN l ON l.docHash = o_orderkey LEFT JOIN g ON g.docHash = o_orderkey"""
)
def layouts_with_legacy(spark, sf_dir):
    k = F.col("o_orderkey")
    keys = table(spark, sf_dir, "orders").select(k.alias("docHash"), F.lit(1).alias("page"), F.lit("m").alias("mode"), F.lit("p").alias("protocol"))
    named = lambda p: F.concat(F.lit(p), F.col("docHash").cast("string")).alias("layout")
    return store.layouts_for(keys, keys.where("docHash % 3 = 0").select("*", named("new")), keys.where("docHash % 2 = 0").select("docHash", "page", named("old")))


@query(
    """WITH p AS (SELECT c_custkey AS docHash, c_mktsegment AS title FROM customer WHERE c_custkey % 7 <> 0), g AS (SELECT o_custkey AS docHash, string_agg('{"page":' || o_orderkey || ',"data":{"state":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderkey) AS pages FROM orders GROUP BY o_custkey),
    n AS (SELECT o_custkey AS docHash, string_agg('{"id":' || o_orderkey || ',"data":{"body":"' || o_orderpriority || '"}}', ',' ORDER BY o_orderkey) AS notes FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY o_custkey)
    SELECT p.docHash, '{"docHash":' || p.docHash || ',"title":"' || title || '"' || coalesce(',"pages":[' || pages || ']', '') || coalesce(',"notes":[' || notes || ']', '') || '}' AS json FROM p LEFT JOIN g USING (docHash) LEFT JOIN n USING (docHash)"""
)
def library_bundle(spark, sf_dir):
    papers = _papers(spark, sf_dir).select("docHash", F.trim(F.regexp_extract("title", r"^\s*(\S+)", 1)).alias("title"), "deletedAt")
    o = table(spark, sf_dir, "orders")
    pages = o.select(F.col("o_custkey").alias("docHash"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("state"))
    notes = o.select(F.col("o_custkey").alias("docHash"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("body"), F.when(F.col("o_orderkey") % 11 == 0, 1).alias("deletedAt"))
    return store.bundle(papers, pages, notes)


@query("SELECT event_id AS id, user_id * 7 % 1000 AS nextReview FROM events WHERE user_id * 7 % 1000 <= 400")
def due_items(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 7 % 1000).alias("nextReview"))
    return store.due_items(own, 400)


@query("SELECT o_custkey AS key, string_agg(s, ',' ORDER BY s) AS done FROM (SELECT DISTINCT o_custkey, o_orderstatus || o_orderkey % 5 AS s FROM orders) GROUP BY o_custkey")
def done_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.concat("o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("s"), "o_orderkey")
    sets = lambda df: df.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("doneDocs"))
    return store.done_union(sets(o.where("o_orderkey % 2 = 0")), sets(o.where("o_orderkey % 2 = 1"))).select("key", F.array_join("doneDocs", ",").alias("done"))


@query("WITH n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey > 20 ORDER BY 1 LIMIT 30) SELECT o_custkey AS docHash, o_orderkey AS page FROM orders WHERE o_custkey IN (SELECT o_custkey FROM n)")
def import_batch(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docHash"), F.col("o_orderkey").alias("page"))
    return store.import_next(own, 20, 30)[0]


@query("""SELECT o_custkey AS key, max(o_orderkey) AS "at" FROM orders GROUP BY o_custkey HAVING max(o_orderkey) > 50 ORDER BY "at" DESC, key LIMIT 200""")
def newest_cache_entries(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"))
    return store.bounded_cache(own, 200, now=150, ttl=100)


# --- translations ---------------------------------------------------------------------------------

_LABELS = "CASE ord % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'heading' WHEN 2 THEN 'formula' WHEN 3 THEN 'header' WHEN 4 THEN 'caption' ELSE 'figure' END"


def _labelled(spark, sf_dir):
    own = blocks(spark, sf_dir).withColumn("label", F.expr(_LABELS)).withColumn("bid", F.concat_ws("-", "doc_id", "ord"))
    return own.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "ord", "text", "label", "bid", F.col("bid").alias("id"), (F.col("ord") % 4 == 3).alias("skip"), F.lit("").alias("translation"))


@query(f"WITH {BLOCKS} SELECT doc_id, ord, label IN ('text', 'heading', 'caption') AND ord % 4 <> 3 AS translatable FROM (SELECT *, {_LABELS} AS label FROM blocks)")
def translatable_blocks(spark, sf_dir):
    own = _labelled(spark, sf_dir)
    return own.select(F.col("doc").alias("doc_id"), "ord", translate.is_translatable(F.col("label"), F.col("text"), F.col("skip")).alias("translatable"))


@query(f"WITH {BLOCKS} SELECT doc_id, ord, label, CASE WHEN label NOT IN ('formula', 'figure') THEN text END AS text FROM (SELECT *, {_LABELS} AS label FROM blocks) WHERE label <> 'header'")
def prepared_blocks(spark, sf_dir):
    return translate.prepare(_labelled(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "ord", "label", "text")


_T = "CASE ord % 4 WHEN 0 THEN '译' || text WHEN 1 THEN text WHEN 2 THEN 'latin words' ELSE '' END"


@query(f"WITH {BLOCKS}, b AS (SELECT doc_id, ord, text, {_T} AS t FROM blocks) SELECT doc_id, ord FROM b WHERE NOT (ord % 4 = 0 OR ord % 4 = 1)")
def units_needing_work(spark, sf_dir):
    own = blocks(spark, sf_dir).withColumn("translation", F.expr(_T))
    return translate.needing(own).select("doc_id", "ord")


@query(
    f"""WITH {BLOCKS}, b AS (SELECT *, {_LABELS} AS label FROM blocks)
    SELECT doc_id, ord, CASE WHEN label IN ('text', 'heading', 'caption') AND ord % 4 <> 3 AND ord % 5 < 3 THEN CASE ord % 5 WHEN 0 THEN 'by bid' WHEN 1 THEN 'by id' ELSE 'late' END ELSE '' END AS translation FROM b"""
)
def painted_blocks(spark, sf_dir):
    own = _labelled(spark, sf_dir)
    said = lambda k, t, keyed, n: own.where(f"ord % 5 = {k}").select(F.col("bid").alias("id"), (F.col("bid") if keyed else F.lit("")).alias("bid"), F.lit(t).alias("translation"), F.lit(False).alias("failed"), F.lit(n).alias("ord"))
    results = said(0, "by bid", True, 0).unionByName(said(1, "by id", False, 0)).unionByName(said(2, "early", True, 1)).unionByName(said(2, "late", True, 2))
    return translate.paint(own, results).select(F.col("doc").alias("doc_id"), "ord", "translation")


@query(
    f"""WITH {BLOCKS}, b AS (SELECT *, {_LABELS} AS label FROM blocks)
    SELECT doc_id, ord, CASE WHEN label IN ('text', 'heading', 'caption') AND ord % 4 <> 3 THEN CASE WHEN ord % 3 = 0 THEN '别名' WHEN ord % 3 = 1 THEN text ELSE '' END ELSE '' END AS translation FROM b"""
)
def painted_by_alias(spark, sf_dir):
    """Every third block's own result hands the source back and an alias holds a translation; the next one's only result is its source."""
    own = _labelled(spark, sf_dir).withColumn("aliases", F.array(F.concat(F.lit("was-"), "bid")))
    echo = own.where("ord % 3 <> 2").select("id", "bid", F.col("text").alias("translation"), F.lit(False).alias("failed"))
    old = own.where("ord % 3 = 0").select("id", F.concat(F.lit("was-"), "bid").alias("bid"), F.lit("别名").alias("translation"), F.lit(False).alias("failed"))
    return translate.paint_aliases(own, echo.unionByName(old)).select(F.col("doc").alias("doc_id"), "ord", "translation")


@query(
    """SELECT o_custkey AS req, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN 'keyed ' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'plain ' || o_orderkey END AS translation FROM orders"""
)
def response_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    requests = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("req"), k.alias("pos"), F.concat(F.lit("b"), k.cast("string")).alias("bid"))
    answer = lambda r, t, keyed, at: requests.where(f"pos % 3 = {r}").select("req", (F.col("pos") + at).alias("pos"), (F.col("bid") if keyed else F.lit("")).alias("bid"), F.concat(F.lit(t), F.col("pos").cast("string")).alias("translation"))
    return translate.pair_responses(requests, answer(0, "keyed ", True, 0).unionByName(answer(0, "again ", True, 1)).unionByName(answer(1, "plain ", False, 0))).select("req", "pos", "translation")


@query(
    f"""WITH {BLOCKS}, p AS (SELECT *, {_T} AS t FROM blocks WHERE ord % 7 <> 6), i AS (SELECT *, '新' || ord AS t FROM blocks WHERE ord % 5 <> 4)
    SELECT coalesce(p.doc_id, i.doc_id) AS doc, coalesce(p.ord, i.ord) AS bid, CASE WHEN p.t IS NOT NULL AND (p.ord % 4 = 0 OR (p.ord % 4 = 1 AND i.t IS NULL)) THEN p.t ELSE coalesce(i.t, p.t) END AS translation
    FROM p FULL JOIN i ON p.doc_id = i.doc_id AND p.ord = i.ord"""
)
def merged_rows(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.col("ord").cast("string").alias("bid"), "text", "ord")
    prior = own.where("ord % 7 <> 6").withColumn("translation", F.expr(_T)).drop("ord")
    new = own.where("ord % 5 <> 4").withColumn("translation", F.concat(F.lit("新"), "bid")).drop("ord")
    return translate.merge_rows(prior, new).select("doc", F.col("bid").cast("int").alias("bid"), "translation")


@query(
    f"""WITH {BLOCKS} SELECT doc_id AS doc, 'p' || ord AS bid FROM blocks WHERE ord % 4 <> 3 AND ord % 6 <> 5"""
)
def pairs_by_alias(spark, sf_dir):
    """Pairs of all blocks under their former ids; blocks with a changed source keep none."""
    own = blocks(spark, sf_dir)
    live = own.where("ord % 4 <> 3").select(F.concat_ws("-", F.lit("n"), "doc_id", "ord").alias("bid"), F.array(F.concat_ws("-", F.lit("p"), "doc_id", "ord")).alias("aliases"), F.when(F.col("ord") % 6 == 5, "other").otherwise(F.col("text")).alias("text"))
    pairs = own.select(F.col("doc_id").alias("doc"), "ord", F.concat_ws("-", F.lit("p"), "doc_id", "ord").alias("bid"), "text")
    return translate.verified(pairs, live, aliases=True).select("doc", F.concat(F.lit("p"), F.col("ord").cast("string")).alias("bid"))


@query(f"WITH {BLOCKS} SELECT doc_id, count(*) AS units, count(*) FILTER (WHERE ord % 3 = 0) AS covered, count(*) FILTER (WHERE ord % 3 = 0) * 1.0 / count(*) AS coverage FROM blocks GROUP BY doc_id")
def saved_coverage(spark, sf_dir):
    units = blocks(spark, sf_dir).select("doc_id", "ord", F.concat_ws("-", "doc_id", "ord").alias("bid"))
    return translate.coverage(units, units.withColumn("translation", F.when(F.col("ord") % 3 == 0, "译").otherwise(" ")), ["doc_id"])


@query(
    f"""WITH {BLOCKS}, t AS (SELECT DISTINCT doc_id FROM blocks WHERE doc_id % 2 = 0 AND ord % 4 <> 3)
    SELECT doc_id, ord FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM t) OR (ord % 4 <> 3 AND ord % 3 <> 0)"""
)
def pairs_after_invalidation(spark, sf_dir):
    """Pages of even documents get new blocks: every fourth block is gone, and every third pair is an echo."""
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("docHash"), F.lit(1).alias("page"), "ord", F.concat_ws("-", "doc_id", "ord").alias("bid"), "text")
    pairs = own.withColumn("translation", F.when(F.col("ord") % 3 == 0, F.col("text")).otherwise("译"))
    layouts = own.groupBy("docHash", "page").agg(F.lit("p").alias("protocol"), F.array(F.lit("old")).alias("bids"))
    live = own.where("docHash % 2 = 0 and ord % 4 <> 3").withColumn("aliases", F.array().cast("array<string>"))
    kept, _ = translate.invalidate_page(pairs, layouts, live, "p")
    return kept.select(F.col("docHash").alias("doc_id"), "ord")


@query(f"WITH {BLOCKS}, t AS (SELECT DISTINCT doc_id FROM blocks WHERE doc_id % 2 = 0) SELECT DISTINCT doc_id FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM t) OR doc_id % 4 = 0")
def layouts_after_invalidation(spark, sf_dir):
    """Even documents get new blocks; the stored layout of every fourth document names the same ones."""
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("docHash"), F.lit(1).alias("page"), "ord", F.concat_ws("-", "doc_id", "ord").alias("bid"), "text")
    named = F.transform(F.array_sort(F.collect_list(F.struct("ord", "bid"))), lambda x: x["bid"])
    layouts = own.groupBy("docHash", "page").agg(F.lit("p").alias("protocol"), named.alias("bids")).withColumn("bids", F.when(F.col("docHash") % 4 == 0, F.col("bids")).otherwise(F.array(F.lit("old"))))
    live = own.where("docHash % 2 = 0").withColumn("aliases", F.array().cast("array<string>"))
    return translate.invalidate_page(own.limit(0).withColumn("translation", F.lit("")), layouts, live, "p")[1].select(F.col("docHash").alias("doc_id"))


@query(
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, ord, '⟦f1⟧ and ⟦f2⟧' AS t FROM blocks)
    SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN 'keep' WHEN 3 THEN 'retranslate' ELSE 'remapped' END AS kind, CASE ord % 4 WHEN 1 THEN '⟦f7⟧ and ⟦f8⟧' WHEN 2 THEN '⟦f4⟧ and ⟦f3⟧' END AS translation FROM b"""
)
def slots_remapped(spark, sf_dir):
    """Saved translations with two slots against live slots: the same, other tokens in place, other places, and other formulas."""
    slots = lambda *own: F.array(*(F.struct(F.lit(t).alias("token"), F.lit(f).alias("formula")) for t, f in own))
    live = (
        F.when(F.col("ord") % 4 == 0, slots(("⟦f1⟧", "x"), ("⟦f2⟧", "y"))).when(F.col("ord") % 4 == 1, slots(("⟦f7⟧", "x + 1"), ("⟦f8⟧", "y")))
        .when(F.col("ord") % 4 == 2, slots(("⟦f4⟧", "x"), ("⟦f3⟧", "y"))).otherwise(slots(("⟦f5⟧", "p"), ("⟦f6⟧", "q")))
    )
    own = translate.remap_slots(live, slots(("⟦f1⟧", "x"), ("⟦f2⟧", "y")), F.lit("⟦f1⟧ and ⟦f2⟧"))
    return blocks(spark, sf_dir).select("doc_id", "ord", own.alias("r")).select("doc_id", "ord", "r.kind", "r.translation")


# --- labels, units, formulas ----------------------------------------------------------------------


@query(
    """WITH e AS (SELECT l_orderkey AS page, l_linenumber AS id, l_orderkey || '-' || l_suppkey % 3 AS unitId, CASE WHEN min(l_returnflag) = 'A' THEN 'text' ELSE 'formula' END AS label FROM lineitem GROUP BY ALL),
    o AS (SELECT page, count(DISTINCT id) AS n, count(DISTINCT unitId) AS units, bool_and(label = 'text') AS all_text FROM e GROUP BY page)
    SELECT page AS id, page % 2 = 0 AS must, CASE page % 3 WHEN 0 THEN all_text WHEN 1 THEN units = 1 ELSE units <> 1 END AS met FROM o"""
)
def pages_judged(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    unit = F.concat_ws("-", "l_orderkey", F.col("l_suppkey") % 3)
    e = l.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("string").alias("id"), unit.alias("unitId")).agg(F.when(F.min("l_returnflag") == "A", "text").otherwise("formula").alias("label"))
    e = e.withColumn("paper", F.lit("p"))
    expect = F.when(F.col("page") % 3 == 0, "text").when(F.col("page") % 3 == 1, "same-unit").otherwise("not-same-unit")
    j = e.groupBy("paper", "page").agg(F.collect_set("id").alias("elementIds")).select(F.col("page").alias("id"), F.lit("s").alias("source"), "paper", "page", expect.alias("expect"), "elementIds", (F.col("page") % 2 == 0).alias("must"))
    return score.judge_pages(j, e).select("id", "must", "met")


@query("SELECT count(*) AS expected, count(l.doc_id) AS sampled, count(DISTINCT d.doc_id % 50) AS pages, count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id % 50 END) AS sampled_pages, bool_and(l.doc_id IS NOT NULL) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def sample_coverage(spark, sf_dir):
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("page"))
    return score.coverage(expected, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(
    """WITH e AS (SELECT l_orderkey AS page, 'e' || l_linenumber AS id, l_suppkey % 3 AS was, l_returnflag = 'R' AS display, l_tax > 0.07 AS eq, l_discount AS confidence FROM lineitem),
    g AS (SELECT page, was, bool_or(display) AS display, bool_or(eq) AS "equationNumber", min(confidence) AS confidence, list_sort(list(DISTINCT id)) AS m FROM e GROUP BY ALL)
    SELECT page, was::VARCHAR AS was, 'u' || substr(sha256(array_to_string(m, ',')), 1, 12) AS id, CASE WHEN display THEN 'display' ELSE 'inline' END AS type, "equationNumber", confidence, array_to_string(m, ',') AS members FROM g"""
)
def units_rebuilt(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    e = l.select(
        F.col("l_orderkey").alias("page"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("id"), (F.col("l_suppkey") % 3).cast("string").alias("unitId"),
        F.when(F.col("l_returnflag") == "R", "display").otherwise("inline").alias("unitType"), (F.col("l_tax") > 0.07).alias("equationNumber"), F.col("l_discount").alias("confidence"),
    )
    return score.rebuild_units(e).withColumn("members", F.array_join("elementIds", ",")).drop("elementIds")


_REVIEW = """WITH u AS (SELECT o_custkey AS paper, o_orderkey % 4 AS page, (o_orderkey % 100) / 100.0 AS c FROM orders), r AS (SELECT DISTINCT o_custkey AS paper, o_orderkey % 4 AS page FROM orders WHERE o_orderkey % 6 = 0),
    s AS (SELECT u.paper, u.page, count(*) AS units, count(*) FILTER (WHERE c < 0.75) AS uncertain, (u.paper, u.page) IN (SELECT (paper, page) FROM r) AS reviewed FROM u GROUP BY u.paper, u.page)"""


def _review(spark, sf_dir):
    u = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper"), (F.col("o_orderkey") % 4).alias("page"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"), "o_orderkey")
    return score.review_status(u, u.where("o_orderkey % 6 = 0"))


@query(f"{_REVIEW} SELECT * FROM s")
def review_status(spark, sf_dir):
    return _review(spark, sf_dir)


@query(f"{_REVIEW} SELECT paper, page, uncertain, row_number() OVER (ORDER BY uncertain DESC, paper, page) AS place FROM s ORDER BY place LIMIT 100")
def most_uncertain_pages(spark, sf_dir):
    from pyspark.sql import Window

    top = score.status_order(_review(spark, sf_dir)).limit(100)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("uncertain"), "paper", "page"))
    return top.select("paper", "page", "uncertain", place.cast("long").alias("place"))


@query(
    """WITH u AS (SELECT l_orderkey AS page, l_suppkey % 4 AS unit, l_linenumber % 4 AS el FROM lineitem), many AS (SELECT page, 'e' || el AS id, 'multi-owner' AS issue FROM u GROUP BY page, el HAVING count(DISTINCT unit) > 1),
    r AS (SELECT DISTINCT l_orderkey AS page, 'u' || l_linenumber % 3 AS id, 'u' || l_linenumber % 5 AS into_ FROM lineitem WHERE l_linenumber % 2 = 1),
    lost AS (SELECT r.page, r.id, 'merge-target-missing' AS issue FROM r WHERE (r.page, r.into_) NOT IN (SELECT (page, 'u' || unit) FROM u)),
    chain AS (SELECT page, id, 'merge-chain' AS issue FROM r WHERE (page, into_) IN (SELECT (page, id) FROM r))
    SELECT * FROM many UNION ALL SELECT * FROM lost UNION ALL SELECT * FROM chain"""
)
def merge_issues(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    units = l.groupBy(F.col("l_orderkey").alias("page"), name("u", F.col("l_suppkey") % 4).alias("unitId")).agg(F.collect_set(name("e", F.col("l_linenumber") % 4)).alias("elementIds"))
    records = l.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("page"), name("u", F.col("l_linenumber") % 3).alias("unitId"), name("u", F.col("l_linenumber") % 5).alias("mergedInto")).distinct()
    return score.merge_issues(units, records)


@query(
    """SELECT "queueIndex", count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM (SELECT DISTINCT o_custkey AS "queueIndex", o_orderpriority AS rule, o_orderkey % 3 AS el FROM orders) GROUP BY "queueIndex\""""
)
def audit_findings(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queueIndex"), F.col("o_orderpriority").alias("rule"), (F.col("o_orderkey") % 3).alias("elementId"))
    return score.audit_summary(own).withColumn("rules", F.array_join("rules", ","))


@query("SELECT c_custkey AS slot, min(o_orderkey) AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_custkey HAVING count(*) = 1")
def slot_assignments(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("passes"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"))
    return score.slot_assignments(own.join(customers, "slot", "left_semi"))


@query(
    """SELECT l_orderkey AS block, l_suppkey % 4 AS start, l_suppkey % 4 + 2 AS "end", string_agg('x' || l_linenumber, ' ' ORDER BY l_linenumber, 'x' || l_linenumber) AS latex FROM lineitem GROUP BY ALL
    HAVING bool_and(l_returnflag <> 'A') AND NOT bool_or(l_linestatus = 'F' AND l_tax > 0.06)"""
)
def splice_plans(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"), (F.col("l_suppkey") % 4).alias("start"), (F.col("l_suppkey") % 4 + 2).alias("end"), F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("x"), F.col("l_linenumber").cast("string")).alias("latex"), (F.col("l_returnflag") != "A").alias("passes"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06), 1).alias("slot"),
    )
    return score.splice_plans(own)


@query(
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, ord, text FROM blocks WHERE length(text) > 12)
    SELECT doc_id, ord, 'text:' || substr(text, 1, 2) || '|math:a|text:' || substr(text, 5, 3) || '|math:b|text:' || substr(text, 11) AS pieces FROM b
    WHERE trim(substr(text, 3, 2)) <> '' AND trim(substr(text, 8, 3)) <> ''"""
)
def spliced_formulas(spark, sf_dir):
    """Two formulas in place of characters 2 to 4 and 7 to 10; a third plan overlaps the first."""
    own = blocks(spark, sf_dir).where("length(text) > 12 and trim(substr(text, 3, 2)) <> '' and trim(substr(text, 8, 3)) <> ''")
    plan = lambda a, b, f: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(f).alias("latex"))
    pieces = layout.splice_pieces(F.col("text"), F.array(plan(7, 10, "b"), plan(2, 4, "a"), plan(3, 8, "never")))
    return own.select("doc_id", "ord", F.array_join(F.transform(pieces, lambda p: F.concat_ws(":", p["type"], p["text"])), "|").alias("pieces"))


@query(
    """SELECT o_custkey AS "docHash", CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(*) FILTER (WHERE o_orderkey % 9 = 0) = 0 THEN min(o_orderpriority) ELSE '' END AS version FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders) GROUP BY o_custkey"""
)
def page_stamps(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docHash"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("version"))
    return score.page_stamp(own, ["docHash"])


@query(f"WITH {BLOCKS} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS fingerprint FROM blocks GROUP BY doc_id")
def page_fingerprints(spark, sf_dir):
    return score.page_fingerprint(blocks(spark, sf_dir), ["doc_id"])


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'absent' WHEN o_orderkey % 7 = 0 THEN 'unchecked' WHEN o_orderstatus <> 'O' THEN 'stale' WHEN o_orderpriority = '1-URGENT' THEN 'current' WHEN o_orderpriority = '2-HIGH' THEN 'compatible' ELSE 'stale' END AS verdict FROM orders"""
)
def formula_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    own = score.verdict(F.when(k % 5 != 0, F.col("o_orderstatus")), F.lit("O"), F.when(k % 7 != 0, F.col("o_orderpriority")), F.lit("1-URGENT"), ["2-HIGH"])
    return table(spark, sf_dir, "orders").select(k.alias("id"), own.alias("verdict"))


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey AS page, l_partkey AS item FROM lineitem), o AS (SELECT page, item, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS page, l_partkey AS item, l_linenumber FROM lineitem WHERE l_linenumber % 3 <> 0
    UNION ALL SELECT DISTINCT l_orderkey, l_partkey, -l_linenumber FROM lineitem WHERE l_linenumber % 3 = 1 AND l_tax > 0.06) GROUP BY ALL)
    SELECT i.page, i.item, CASE WHEN coalesce(n, 0) = 0 AND i.item % 2 = 0 THEN 'excluded' WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'owned' END AS verdict FROM i LEFT JOIN o ON i.page = o.page AND i.item = o.item"""
)
def source_ownership(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("item"), "l_linenumber", "l_tax")
    items = l.select("page", "item").distinct()
    own = l.where("l_linenumber % 3 <> 0").select("page", "item", "l_linenumber").distinct()
    twice = l.where("l_linenumber % 3 = 1 and l_tax > 0.06").select("page", "item", (-F.col("l_linenumber")).alias("l_linenumber")).distinct()
    in_blocks = own.unionByName(twice).select("page", F.array("item").alias("sourceItems"))
    return score.source_audit(items, items.where("item % 2 = 0"), in_blocks)


@query(
    """SELECT o_orderkey AS id, CASE WHEN a AND b AND same THEN 'agree' WHEN a AND NOT b THEN 'a' WHEN b AND NOT a THEN 'b' WHEN NOT a AND NOT b THEN 'undecided' WHEN x > y THEN 'a' WHEN y > x THEN 'b' ELSE 'undecided' END AS choice
    FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS a, o_orderkey % 3 <> 0 AS b, o_orderkey % 5 = 0 AS same, o_orderkey % 7 AS x, o_orderkey % 4 AS y FROM orders)"""
)
def arbitration(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), score.arbitrate(k % 2 == 0, k % 3 != 0, k % 5 == 0, k % 7, k % 4).alias("choice"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN s AND sp THEN 'source' WHEN m AND mp THEN 'model' ELSE 'crop' END AS tier,
    concat_ws(',', CASE WHEN s THEN CASE WHEN sp THEN 'source:pass' ELSE 'source:fail' END END, CASE WHEN m THEN CASE WHEN mp THEN 'model:pass' ELSE 'model:fail' END END) AS trace
    FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS s, o_orderkey % 3 = 0 AS sp, o_orderkey % 5 <> 0 AS m, o_orderkey % 7 < 4 AS mp FROM orders)"""
)
def tier_cascade(spark, sf_dir):
    k = F.col("o_orderkey")
    won, tried = score.cascade({"source": (k % 2 == 0, k % 3 == 0), "model": (k % 5 != 0, k % 7 < 4)})
    return table(spark, sf_dir, "orders").select(k.alias("id"), won.alias("tier"), F.array_join(tried, ",").alias("trace"))


@query("SELECT o_orderkey AS id, a = '' OR b = '' OR a = b AS same FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE (o_orderkey % 6)::VARCHAR END AS a, (o_orderkey % 9)::VARCHAR AS b FROM orders)")
def numbers_agree(spark, sf_dir):
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("( "), (k % 6).cast("string"), F.lit(")")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), score.same_number(a, F.concat(F.lit("("), (k % 9).cast("string"), F.lit(") "))).alias("same"))


@query("""SELECT o_custkey AS "docHash", CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 4 IN (0, 1) THEN 'source' WHEN o_orderkey % 4 = 2 THEN 'crop' ELSE 'model' END AS bucket, count(*) AS count FROM orders GROUP BY ALL""")
def formula_tiers(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    tier = F.when(k == 0, "source").when(k == 1, "arxiv").when(k == 2, "crop").otherwise("vision")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docHash"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("ok").alias("status"), tier.alias("tier"))
    return score.tier_counts(own)


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN 7 END AS prompt, o_orderkey % 10 AS completion, CASE o_orderkey % 3 WHEN 0 THEN o_custkey + o_orderkey % 10 WHEN 1 THEN 99 END AS total FROM orders"""
)
def token_usage(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 10
    one = lambda *kv: F.create_map(*(x if i % 2 else F.lit(x) for i, x in enumerate(kv)))
    usage = F.when(k % 3 == 0, one("input_tokens", F.col("o_custkey"), "output_tokens", n)).when(
        k % 3 == 1, one("promptTokenCount", F.lit(7).cast("long"), "candidatesTokenCount", n, "totalTokenCount", F.lit(99).cast("long"))
    ).otherwise(one("completion_tokens", n))
    return table(spark, sf_dir, "orders").select(k.alias("id"), score.tokens_of(usage).alias("t")).select("id", "t.prompt", "t.completion", "t.total")


@query(
    """WITH m AS (SELECT row_number() OVER (ORDER BY p_partkey DESC) AS n, p_partkey * 3 AS "queueIndex" FROM part) SELECT n, "queueIndex", o_custkey AS paper FROM m JOIN orders ON o_orderkey = "queueIndex\""""
)
def manifest_units(spark, sf_dir):
    from pyspark.sql import Window

    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("queue"), F.col("o_custkey").alias("paper"))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("p_partkey"))).cast("long")
    return score.units_for_manifest(units, table(spark, sf_dir, "part").select(n.alias("n"), (F.col("p_partkey") * 3).alias("queueIndex")))


@query(
    """WITH c AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 5 AND o_orderkey < 900) SELECT o_orderkey AS queue, o_orderkey IN (SELECT o_orderkey FROM c) AS confirmed FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM c)"""
)
def audit_window(spark, sf_dir):
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("queue"), F.col("o_custkey").alias("paperId"), F.lit(1).alias("page"), F.col("o_orderkey").alias("unitId"))
    return score.audit_window(q, q.where("unitId % 13 = 5 and unitId < 900").drop("queue")).select("queue", "confirmed")


@query(
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS n, sum(length(regexp_replace(text, '\\s+', '', 'g'))) FILTER (WHERE ord % 3 <> 0) AS m FROM blocks GROUP BY doc_id)
    SELECT doc_id AS page, CASE WHEN n = 0 THEN 1.0 ELSE coalesce(m, 0) * 1.0 / n END AS coverage FROM t"""
)
def page_text_coverage(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("page"), "ord", "text")
    marked = own.where("ord % 3 <> 0").withColumn("text", F.concat("text", F.lit(text.GAP_MARK)))
    return score.text_coverage(marked, own, text.GAP_MARK)


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\\alpha + x_{1}' WHEN 1 THEN '\\frac{a}{b} \\leq c' WHEN 2 THEN '\\mystery{z}' ELSE '\\quad' END AS latex FROM part)
    SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '+1xα' WHEN 1 THEN 'abc≤' WHEN 2 THEN 'z' ELSE '' END AS chars, CASE WHEN p_partkey % 4 = 2 THEN '\\mystery' ELSE '' END AS unknown,
      CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'charset-mismatch' WHEN 2 THEN 'unknown-command' ELSE 'charset-mismatch' END AS reason FROM t"""
)
def latex_charsets(spark, sf_dir):
    k = F.col("p_partkey") % 4
    latex = F.when(k == 0, r"\alpha + x_{1}").when(k == 1, r"\frac{a}{b} \leq c").when(k == 2, r"\mystery{z}").otherwise(r"\quad")
    own = table(spark, sf_dir, "part").select("p_partkey", text.latex_charset(latex).alias("c"), F.when(k == 0, "α + x1").otherwise("q w").alias("source"))
    return own.select(
        F.col("p_partkey").alias("id"), F.array_join("c.chars", "").alias("chars"), F.array_join("c.unknown", ",").alias("unknown"),
        score.verify_candidate(F.lit(""), F.col("source"), F.col("c.unknown"), F.col("c.chars"))["reason"].alias("reason"),
    )


# --- events and pages of the web ------------------------------------------------------------------


@query(
    """SELECT event_id AS t, event_type AS type, CASE WHEN event_id % 2 = 0 THEN 'C' || event_id % 10 END AS code, 'see https://host.example now' AS msg, CASE WHEN event_id % 3 = 0 THEN 'm-1' END AS model FROM events"""
)
def clean_events(spark, sf_dir):
    k = F.col("event_id")
    own = table(spark, sf_dir, "events").select(
        k.alias("t"), F.col("event_type").alias("type"), F.when(k % 2 == 0, F.concat(F.lit("C"), (k % 10).cast("string"))).otherwise("not a code!").alias("code"),
        F.lit("see https://user:pass@host.example/path?token=abc now").alias("msg"), F.when(k % 3 == 0, "m-1").otherwise("no model").alias("model"),
    )
    return events.clean(own)


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*example\\.com') THEN 'com' WHEN regexp_matches(url, '^https?://[^/]*example\\.org') THEN 'org' END AS preset FROM pages")
def site_presets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.pick_preset(F.col("url"), [("com", r"(^|\.)example\.com$"), ("org", r"(^|\.)example\.org$")]).alias("preset"))


@query()
def sanitized_html(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", web.sanitize_html("html").alias("clean"))
    return own.select("page_id", F.length("clean").alias("n"), (~F.col("clean").rlike(r"(?i)<(script|style|iframe|img)|\son\w+=|javascript:")).alias("safe"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, TIMESTAMP '2024-03-10 15:00:00' - o_orderkey * INTERVAL 7 HOUR AS w FROM orders), d AS (SELECT *, date_diff('day', w, TIMESTAMP '2024-03-10 15:00:00') AS n FROM t)
    SELECT id, CASE WHEN n = 0 THEN '今天 ' || strftime(w, '%H:%M') WHEN n = 1 THEN '昨天 ' || strftime(w, '%H:%M') WHEN year(w) = 2024 THEN month(w) || '月' || day(w) || '日' ELSE strftime(w, '%Y-%m-%d') END AS shown FROM d"""
)
def relative_times(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-03-10 15:00:00"))
    at = F.timestamp_seconds(F.unix_timestamp(now) - F.col("o_orderkey") * 7 * 3600)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.relative_time(at, now).alias("shown"))


@query(
    """SELECT o_orderkey AS id, 'to ' || o_orderstatus || ': ' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, '') || '. {x}' AS filled, o_orderkey AS doc, o_orderkey % 9 + 1 AS page, 'p1' AS pipeline FROM orders"""
)
def templates_and_keys(spark, sf_dir):
    k = F.col("o_orderkey")
    filled = text.fill_template(F.lit("to {{status}}: {{what}}{{none}}. {x}"), {"status": F.col("o_orderstatus"), "what": F.when(k % 2 == 0, F.col("o_orderpriority"))})
    key = text.layout_key(F.concat(F.lit("pdf-layout:h:"), k.cast("string"), F.lit(":"), (k % 9 + 1).cast("string"), F.lit(":auto:mm:source-v3:p1")))
    own = table(spark, sf_dir, "orders").select(k.alias("id"), filled.alias("filled"), key.alias("k"))
    return own.select("id", "filled", F.regexp_extract("k.docHash", "^h:(.*)$", 1).cast("long").alias("doc"), F.col("k.page").cast("long").alias("page"), F.col("k.pipeline").alias("pipeline"))
