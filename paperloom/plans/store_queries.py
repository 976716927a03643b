"""Queries on keyed collections: revisions of orders, saved translations, usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store, translate
from .registry import query, table

_REVS = """
    local AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS rev, o_custkey AS updatedAt, o_orderstatus AS status, o_orderkey % 50 AS docHash FROM orders WHERE o_orderkey % 5 <> 0),
    incoming AS (SELECT o_orderkey AS id, 1 + (o_orderkey / 3)::BIGINT % 3 AS rev, o_custkey + o_orderkey % 3 - 1 AS updatedAt, 'new' AS status, o_orderkey % 50 AS docHash FROM orders WHERE o_orderkey % 2 = 0)
"""


def _revisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    doc = (F.col("o_orderkey") % 50).alias("docHash")
    local = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 3).alias("rev"), F.col("o_custkey").alias("updatedAt"), F.col("o_orderstatus").alias("status"), doc)
    third = F.expr("cast(rint(o_orderkey / 3) as bigint)")
    incoming = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (1 + third % 3).alias("rev"), (F.col("o_custkey") + F.col("o_orderkey") % 3 - 1).alias("updatedAt"), F.lit("new").alias("status"), doc)
    return local, incoming


@query(
    f"""
    WITH {_REVS}, a AS (SELECT *, 1 AS l FROM local UNION ALL SELECT *, 0 FROM incoming)
    SELECT id, rev, updatedAt, status, docHash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC, updatedAt DESC, l DESC) AS k FROM a) WHERE k = 1
    """
)
def live_latest_merge(spark, sf_dir):
    local, incoming = _revisions(spark, sf_dir)
    return store.merge(local, incoming, ["id"])


_OUTCOME = "CASE WHEN l.id IS NULL THEN 'added' WHEN i.rev > l.rev OR (i.rev = l.rev AND i.updatedAt > l.updatedAt) THEN 'updated' ELSE 'skipped' END"


@query(
    f"""
    WITH {_REVS}, o AS (SELECT i.docHash, {_OUTCOME} AS outcome FROM incoming i LEFT JOIN local l USING (id))
    SELECT docHash, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, 0::BIGINT AS rejected
    FROM o GROUP BY docHash
    """
)
def merge_tally(spark, sf_dir):
    local, incoming = _revisions(spark, sf_dir)
    return store.tally(store.merge_outcomes(local, incoming, ["id"]), ["docHash"])


@query(
    f"""
    WITH {_REVS}, puts AS (SELECT * FROM incoming WHERE id % 6 <> 0), a AS (SELECT *, 1 AS l FROM local UNION ALL SELECT *, 0 FROM puts)
    SELECT id, rev, updatedAt, status, docHash FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC, updatedAt DESC, l DESC) AS k FROM a) WHERE k = 1
    """
)
def remote_changes(spark, sf_dir):
    local, incoming = _revisions(spark, sf_dir)
    log = incoming.withColumn("op", F.when(F.col("id") % 6 == 0, "delete").otherwise("put"))
    return store.apply_changes(local, log, ["id"])


@query(f"WITH {_REVS} SELECT * FROM local WHERE id NOT IN (SELECT id FROM incoming) UNION ALL SELECT * FROM incoming")
def upsert(spark, sf_dir):
    local, incoming = _revisions(spark, sf_dir)
    return store.put(local, incoming, ["id"])


@query(f"WITH {_REVS} SELECT * FROM local WHERE id NOT IN (SELECT id FROM incoming)")
def delete_keys(spark, sf_dir):
    local, incoming = _revisions(spark, sf_dir)
    return store.delete(local, incoming, ["id"])


@query(
    """
    WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')
    SELECT o_custkey AS docHash, count(*) AS pages, sum(floor(o_totalprice))::BIGINT AS bytes, min(o_orderkey) AS first FROM p GROUP BY o_custkey
    """
)
def usage_by_document(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return own.groupBy(F.col("o_custkey").alias("docHash")).agg(F.count("*").alias("pages"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"), F.min("o_orderkey").alias("first"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), '1')")
def search_titles(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("fileName"))
    hit = own.where(F.lower("fileName").contains("1"))
    return store.search_papers(hit.withColumn("fileName", F.lit(None).cast("string")), " A ").select("p_partkey", F.col("title").alias("p_name"))


@query(
    """
    WITH d AS (SELECT o_custkey AS docHash, 1 + o_orderkey % 7 AS page FROM orders WHERE o_orderstatus = 'F'),
    t AS (SELECT c_custkey AS docHash, generate_series AS page FROM customer, generate_series(1, 7)),
    l AS (SELECT docHash, min(page) AS page FROM t ANTI JOIN d USING (docHash, page) GROUP BY docHash)
    SELECT c_custkey AS docHash, l.page::INTEGER AS page FROM customer LEFT JOIN l ON c_custkey = l.docHash
    """
)
def first_unfinished(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "done").otherwise("partial")
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docHash"), (1 + F.col("o_orderkey") % 7).cast("int").alias("page"), state.alias("runState"), F.lit(False).alias("skipped"), F.lit(False).alias("any_translation"))
    totals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docHash"), F.lit(7).alias("pageCount"))
    return store.first_unfinished(pages, totals)


def _pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("bid"), (F.col("doc_id") % 100).cast("string").alias("sourceId"), "text", F.col("n_chars").cast("string").alias("translation"))


_KEY = r"sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g'))"


@query(
    f"""
    SELECT key, count(DISTINCT t) AS n, count(*) AS pairs, count(DISTINCT t) > 1 AS conflict, CASE WHEN count(DISTINCT t) = 1 THEN min(t) END AS translation
    FROM (SELECT {_KEY} AS key, source || (doc_id % 2) AS t FROM documents) GROUP BY key
    """
)
def translation_memory_conflicts(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("text", F.concat("source", (F.col("doc_id") % 2).cast("string")).alias("translation"))
    return translate.memory(own)


@query(
    f"""
    WITH d AS (SELECT doc_id, {_KEY} AS key, n_chars::VARCHAR AS t FROM documents),
    p AS (SELECT doc_id::VARCHAR AS bid, (doc_id % 100)::VARCHAR AS sid, key, t FROM d WHERE doc_id % 3 = 0),
    s AS (SELECT sid, key, min(t) AS st FROM p GROUP BY sid, key HAVING count(DISTINCT t) = 1),
    m AS (SELECT key, min(t) AS mt FROM p GROUP BY key HAVING count(DISTINCT t) = 1),
    u AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE (doc_id + 1)::VARCHAR END AS bid, (doc_id % 100)::VARCHAR AS sid, key, doc_id FROM d),
    j AS (SELECT u.doc_id, u.key, b.key AS bk, b.t AS bt, st, mt FROM u LEFT JOIN p b ON u.bid = b.bid LEFT JOIN s ON u.sid = s.sid AND u.key = s.key LEFT JOIN m ON u.key = m.key)
    SELECT doc_id, CASE WHEN bk = key THEN 'bid' WHEN bk IS NOT NULL AND mt IS NULL THEN 'changed' WHEN st IS NOT NULL THEN 'sourceId' WHEN mt IS NOT NULL THEN 'memory' END AS how,
           CASE WHEN bk = key THEN bt WHEN bk IS NOT NULL AND mt IS NULL THEN NULL WHEN st IS NOT NULL THEN st ELSE mt END AS reused FROM j
    """
)
def reuse_cascade(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    saved = pairs.where("cast(bid as bigint) % 3 = 0")
    bid = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string")
    units = table(spark, sf_dir, "documents").select("doc_id", bid.alias("bid"), (F.col("doc_id") % 100).cast("string").alias("sourceId"), "text")
    return translate.reuse(units, saved).select("doc_id", "how", "reused")


@query(
    f"""
    WITH d AS (SELECT doc_id, {_KEY} AS key FROM documents)
    SELECT doc_id::VARCHAR AS bid FROM d p WHERE doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM d b WHERE b.doc_id % 2 = 0 AND b.doc_id = p.doc_id AND b.key = p.key)
    """
)
def verified_pairs(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return translate.verified(pairs.where("cast(bid as bigint) % 3 = 0"), pairs.where("cast(bid as bigint) % 2 = 0").select("bid", "text")).select("bid")


@query()
def translate_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).where("trim(text) <> ''")
    units = d.select("doc", F.lit(1).alias("page"), F.concat_ws("-", "doc", "ord").alias("bid"), F.concat_ws("/", "doc", "ord").alias("sourceId"), "text")
    return translate.run(units, units.where("doc % 10 = 0").withColumn("translation", F.concat(F.lit("译"), "text"))).select("doc", "bid", "how", "translation")


@query(
    """
    WITH r AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents), s AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN trim(t) <> '' ELSE false END AS ok FROM r)
    SELECT source, lang, CASE WHEN count(*) FILTER (WHERE ok) = count(*) THEN 'done' WHEN count(*) FILTER (WHERE ok) = 0 THEN 'failed' ELSE 'partial' END AS state
    FROM s GROUP BY source, lang
    """
)
def page_states(spark, sf_dir):
    """Every third text has a translation, the next one is handed back as it is, the third has none."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    source = F.coalesce("text", F.lit(""))
    own = d.select("source", "lang", source.alias("text"), F.when(k == 0, F.concat(F.lit("译文"), source)).when(k == 1, source).otherwise("").alias("translation"))
    return translate.page_state(own, ["source", "lang"])


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY
        CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '' THEN 1 ELSE 2 END, o_orderkey DESC, o_orderpriority, o_orderstatus) AS k FROM orders)
    SELECT o_custkey AS docHash, o_orderkey AS savedAt, o_orderpriority AS mode FROM o WHERE k = 1
    """
)
def pick_layouts(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docHash"), F.lit(1).alias("page"), F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("protocol"), F.col("o_orderkey").alias("savedAt"))
    return store.pick_layout(own, "1-URGENT").select("docHash", "savedAt", "mode")


@query(
    """
    SELECT c_custkey AS docHash, c_acctbal AS bytes FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15
    """
)
def largest_papers(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("docHash"), F.col("c_acctbal").alias("bytes"))
    return store.sort_papers(own, "size").limit(15)


@query(
    """
    WITH q AS (SELECT o_custkey AS id, 1 + o_orderkey % 3 AS rev, o_orderkey AS updatedAt, o_orderstatus AS body FROM orders)
    SELECT id, rev, updatedAt, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev DESC, updatedAt DESC) AS k FROM q) WHERE k = 1
    """
)
def merge_questions(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (1 + F.col("o_orderkey") % 3).alias("rev"), F.col("o_orderkey").alias("updatedAt"), F.col("o_orderstatus").alias("body"))
    return store.merge_qa(own.where("updatedAt % 2 = 0"), own.where("updatedAt % 2 = 1"))


@query(
    """
    WITH p AS (SELECT c_custkey, c_nationkey AS page, c_mktsegment AS body FROM customer)
    SELECT (c_custkey % 40) AS docHash, string_agg(part, chr(10) || chr(10) ORDER BY page) AS markdown FROM (
      SELECT c_custkey % 40 AS c_custkey, page, (CASE WHEN page = 0 THEN '## Paper notes' ELSE '## Page ' || page END) || chr(10) || chr(10) || string_agg('- ' || body, chr(10) ORDER BY p.c_custkey) AS part
      FROM p GROUP BY c_custkey % 40, page) GROUP BY c_custkey
    """
)
def notes_markdown(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 40).alias("docHash"), F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("createdAt"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("body"), F.lit(None).cast("long").alias("deletedAt"),
    )
    return store.notes_markdown(own)
