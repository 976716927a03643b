"""Queries on boxes, anchors and pages: line items stand in for boxes, lines of documents for blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import layout, match, web
from .document_queries import BLOCKS, blocks, sql_collapse
from .registry import query, table

# --- boxes: (l_orderkey, l_linenumber) with a place that follows from quantity and part -----------

_BOXES = """boxes AS (SELECT l_orderkey AS page, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_linenumber AS line, l_partkey % 40 AS x0, l_suppkey % 50 AS y0,
  l_partkey % 40 + 4 + l_quantity::INTEGER AS x1, l_suppkey % 50 + 12 AS y1, l_returnflag AS flag FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem))"""


def _boxes(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").distinct()
    x, y = (F.col("l_partkey") % 40).cast("double"), (F.col("l_suppkey") % 50).cast("double")
    return own.select(
        F.col("l_orderkey").alias("page"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_linenumber").alias("line"),
        geometry.box(x, y, x + 4 + F.floor("l_quantity"), y + 12).alias("box"), F.col("l_returnflag").alias("flag"),
    )


_PAIRS = f"""{_BOXES}, a AS (SELECT * FROM boxes WHERE flag = 'A'), t AS (SELECT * FROM boxes WHERE flag <> 'A'),
    p AS (SELECT a.page, a.id, a.line, t.id AS tid, t.flag AS tf, greatest(least(a.x1, t.x1) - greatest(a.x0, t.x0), 0) * greatest(least(a.y1, t.y1) - greatest(a.y0, t.y0), 0) AS o,
      least((a.x1 - a.x0) * 12, (t.x1 - t.x0) * 12) AS m, (a.x0 + a.x1) / 2.0 BETWEEN t.x0 AND t.x1 AND (a.y0 + a.y1) / 2.0 BETWEEN t.y0 AND t.y1 AS inside FROM a JOIN t USING (page)),
    s AS (SELECT *, greatest(o * 1.0 / m, CASE WHEN inside THEN 0.55 ELSE 0.0 END) AS s FROM p)"""


def _bind_sql(where: str) -> str:
    return f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY s DESC, tid DESC) AS k, count(*) OVER (PARTITION BY page, id) AS n FROM s WHERE s >= 0.55 {where}),
    b AS (SELECT page, id, max(tid) FILTER (WHERE k = 1) AS best, max(s) FILTER (WHERE k = 1) AS s1, max(s) FILTER (WHERE k = 2) AS s2, max(n) AS n FROM r GROUP BY page, id)
    SELECT a.page, a.id, CASE WHEN n = 1 OR s1 - s2 >= 0.08 THEN best END AS bound, coalesce(NOT (n = 1 OR s1 - s2 >= 0.08), false) AS conflict FROM a LEFT JOIN b ON a.page = b.page AND a.id = b.id"""


@query(_bind_sql(""))
def boxes_bound(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    return match.bind(own.where("flag = 'A'"), own.where("flag <> 'A'")).select("page", "id", "bound", "conflict")


@query(_bind_sql("AND tf = CASE WHEN line % 2 = 0 THEN 'R' ELSE 'N' END"))
def boxes_bound_by_kind(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    paints = own.where("flag = 'A'").withColumn("kind", F.when(F.col("line") % 2 == 0, "R").otherwise("N"))
    return match.bind(paints, own.where("flag <> 'A'").withColumn("kind", F.col("flag")), kinds=True).select("page", "id", "bound", "conflict")


@query(f"WITH {_PAIRS} SELECT page, tid AS id, id AS item FROM s WHERE inside")
def items_contained(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    return match.contained_items(own.where("flag <> 'A'"), own.where("flag = 'A'"))


@query(
    f"""WITH {_PAIRS}, bound AS (SELECT page, id FROM (SELECT page, id, max(s) AS s1, count(*) AS n, list_sort(list(s), 'DESC') AS l FROM s WHERE s >= 0.55 GROUP BY page, id) WHERE n = 1 OR l[1] - l[2] >= 0.08)
    SELECT page, 'glyph' AS kind, 'text' AS source, count(*) AS n FROM t GROUP BY page UNION ALL SELECT page, 'glyph', 'unbound-paint', count(*) FROM a WHERE (page, id) NOT IN (SELECT (page, id) FROM bound) GROUP BY page
    UNION ALL SELECT page, 'path', 'path', count(*) FROM a WHERE line % 2 = 0 GROUP BY page"""
)
def elements_assembled(spark, sf_dir):
    own = _boxes(spark, sf_dir).withColumns({"char": F.lit("x"), "font": F.lit("f"), "d": F.lit("M0 0")})
    paints = own.where("flag = 'A'")
    out = layout.assemble_elements(own.where("flag <> 'A'"), paints, paints.where("line % 2 = 0"), own.limit(0))
    return out.groupBy("page", "kind", "source").agg(F.count("*").alias("n"))


@query(f"WITH {_BOXES} SELECT page, id, x0 - 2.0 AS x0, (x0 + x1) / 2.0 * 2 AS twice, (x1 - x0) * 12.0 AS area, x0 / 80.0 * 100 AS px0, y1 / 200.0 * 100 AS py1 FROM boxes")
def box_arithmetic(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    b, p = F.col("box"), geometry.percent(F.col("box"), F.lit(80.0), F.lit(200.0))
    return own.select("page", "id", geometry.inflate(b, F.lit(2.0))["x0"].alias("x0"), (b["x0"] + b["x1"]).alias("twice"), geometry.area(b).alias("area"), p["x0"].alias("px0"), p["y1"].alias("py1"))


@query(f"WITH {_BOXES} SELECT page, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1, list_sort(list(x0))[len(list(x0)) // 2 + 1]::DOUBLE AS middle FROM boxes GROUP BY page")
def box_unions(spark, sf_dir):
    own = _boxes(spark, sf_dir).groupBy("page").agg(geometry.union_agg(F.col("box")).alias("b"), F.collect_list("box.x0").alias("xs"))
    return own.select("page", "b.*", geometry.upper_median(F.col("xs")).alias("middle"))


@query(f"WITH {_BOXES} SELECT page, id, 2.0 * x0 + 0.5 * y0 + 7 AS x, -1.0 * x0 + 3.0 * y0 - 4 AS y FROM boxes")
def points_transformed(spark, sf_dir):
    own = _boxes(spark, sf_dir)
    m = F.array(*map(F.lit, (2.0, -1.0, 0.5, 3.0, 7.0, -4.0)))
    return own.select("page", "id", geometry.apply_matrix(m, F.col("box.x0"), F.col("box.y0")).alias("p")).select("page", "id", "p.x", "p.y")


@query(f"WITH {_BOXES} SELECT page, id, least(x0, 9)::DOUBLE AS x0, least(y0, 3)::DOUBLE AS y0, greatest(x1, 9)::DOUBLE AS x1, y1::DOUBLE AS y1, 1 AS unread FROM boxes")
def path_boxes(spark, sf_dir):
    """A corner, a line to the right, one upwards, a curve through the far corner, and an arc that is not read."""
    b = F.col("box")
    d = F.format_string("M%.1f %.1fH%.1fV%.1fQ9 3 %.1f %.1fA1 1 0 0 1 500 500Z", b["x0"], b["y0"], b["x1"], b["y1"], b["x1"], b["y1"])
    return _boxes(spark, sf_dir).select("page", "id", geometry.path_box(d).alias("p")).select("page", "id", "p.*")


@query(
    f"""WITH {_BOXES}, v AS (SELECT * FROM boxes WHERE flag = 'A'), c AS (SELECT * FROM boxes WHERE flag = 'R'),
    j AS (SELECT v.page, v.id, c.id AS caption, row_number() OVER (PARTITION BY v.page, v.id ORDER BY c.line, c.id) AS k FROM v JOIN c ON v.page = c.page AND c.y0 >= v.y1 - 4 AND c.y0 - v.y1 < 20 AND least(c.x1, v.x1) > greatest(c.x0, v.x0))
    SELECT v.page, v.id, j.caption FROM v LEFT JOIN j ON v.page = j.page AND v.id = j.id AND k = 1"""
)
def captions_attached(spark, sf_dir):
    own = _boxes(spark, sf_dir).withColumn("doc", F.lit(1).cast("long")).withColumn("ord", F.struct("line", "id"))
    return layout.attach_captions(own.where("flag = 'A'"), own.where("flag = 'R'"), 100.0).select("page", "id", "caption")


@query(f"WITH {_BOXES} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 4.0), x0, id)::INTEGER AS ord FROM boxes")
def blocks_inserted(spark, sf_dir):
    own = _boxes(spark, sf_dir).select("page", "id", "box", "flag")
    return layout.insert_by_position(own.where("flag <> 'R'"), own.where("flag = 'R'")).select("page", "id", "ord")


@query(f"WITH {_BOXES} SELECT page, id, CASE WHEN line % 3 = 0 THEN 'merged' ELSE 'u' || line END AS \"unitId\", CASE WHEN line % 3 = 0 THEN line % 2 = 0 ELSE false END AS \"equationNumber\" FROM boxes")
def label_edits(spark, sf_dir):
    own = _boxes(spark, sf_dir).select("page", "id", "line", F.concat(F.lit("u"), F.col("line").cast("string")).alias("unitId"), F.lit(False).alias("equationNumber"))
    edits = own.where("line % 3 = 0").select("page", "id", F.lit("merged").alias("unitId"), (F.col("line") % 2 == 0).alias("equationNumber"))
    return layout.apply_edits(own, edits).select("page", "id", "unitId", "equationNumber")


@query(f"WITH {_BOXES} SELECT page, id, CASE WHEN line % 2 = 0 THEN '译' || line END AS translation, x0 / 80.0 * 100 AS x0, y0 / 200.0 * 100 AS y0 FROM boxes")
def block_pairs(spark, sf_dir):
    own = _boxes(spark, sf_dir).withColumn("bid", F.concat_ws("/", "page", "id"))
    said = own.where("line % 2 = 0").select("bid", F.concat(F.lit("译"), F.col("line").cast("string")).alias("translation")).distinct()
    return layout.block_pairs(own, said, 80.0, 200.0).select("page", "id", "translation", "percent.x0", "percent.y0")


@query(
    f"""WITH x AS (SELECT l_suppkey % 20 AS page, (l_partkey % 300)::DOUBLE AS x0 FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY page ORDER BY x0 RANGE BETWEEN CURRENT ROW AND 28 FOLLOWING) AS n FROM x),
    m AS (SELECT *, min(x0) OVER (PARTITION BY page) AS first FROM n WHERE n >= 8) SELECT page, min(x0) FILTER (WHERE x0 > first + 112) AS cut FROM m GROUP BY page"""
)
def column_cuts(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc"), (F.col("l_suppkey") % 20).alias("page"), (F.col("l_partkey") % 300).cast("double").alias("x0"))
    return layout.column_cut(own).select("page", "cut")


@query(
    """WITH f AS (SELECT l_orderkey AS page, l_linenumber AS id, l_partkey % 4 AS number FROM lineitem GROUP BY ALL), t AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS id, l_partkey % 4 AS number FROM lineitem WHERE l_linenumber = 1)
    SELECT f.page, f.id, f.number, CASE WHEN f.id = 1 THEN 'by id' WHEN (f.page, f.number) IN (SELECT (page, number) FROM t) THEN 'by number' END AS reference FROM f"""
)
def references_attached(spark, sf_dir):
    """One table entry a page by id; its number serves the page's other formulas."""
    l = table(spark, sf_dir, "lineitem")
    f = l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("string").alias("n"), (F.col("l_partkey") % 4).alias("number")).distinct()
    f = f.select("page", F.concat_ws("/", "page", "n").alias("id"), "n", "number")
    t = f.where("n = '1'")
    by = t.select("id", F.lit(None).cast("bigint").alias("page"), F.lit(None).cast("bigint").alias("number"), F.lit("by id").alias("latex"))
    by = by.unionByName(t.select(F.lit("-").alias("id"), "page", "number", F.lit("by number").alias("latex")))
    return match.attach_references(f, by).select("page", F.col("n").cast("int").alias("id"), "number", "reference")


# --- anchors, headings, outlines ------------------------------------------------------------------

_NOTES = """b AS (SELECT o_custkey AS doc, o_orderkey % 6 AS page, 'b' || o_orderkey AS bid, 'a' || o_orderkey AS alias, 'h' || o_orderkey % 200 AS head, 'the words of ' || o_orderkey AS text FROM orders),
  n AS (SELECT o_orderkey AS id, o_custkey AS doc, (o_orderkey + 1) % 6 AS page, CASE o_orderkey % 5 WHEN 0 THEN 'b' || o_orderkey WHEN 1 THEN 'a' || o_orderkey ELSE 'none' END AS bid,
    CASE WHEN o_orderkey % 5 = 2 THEN 'h' || o_orderkey % 200 ELSE '' END AS src, CASE WHEN o_orderkey % 5 = 3 THEN 'words of ' || o_orderkey ELSE '' END AS quote FROM orders),
  j AS (SELECT n.id, n.page, n.bid, b.page AS there, b.bid AS found, CASE WHEN n.bid = b.bid THEN 0 WHEN n.bid = b.alias THEN 1 WHEN src <> '' AND src = head THEN 2 WHEN quote <> '' AND contains(text, quote) THEN 3 END AS how, abs(n.page - b.page) AS far
    FROM n JOIN b ON n.doc = b.doc AND abs(n.page - b.page) <= 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY how, far, there, found) AS k FROM j WHERE how IS NOT NULL),
  m AS (SELECT n.id, n.page, n.doc, n.bid, r.found, r.there, CASE r.how WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' WHEN 2 THEN 'head' WHEN 3 THEN 'quote' ELSE 'lost' END AS status FROM n LEFT JOIN r ON n.id = r.id AND k = 1)"""


def _anchors(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    named = lambda p, c=k: F.concat(F.lit(p), c.cast("string"))
    b = o.select(F.col("o_custkey").alias("docHash"), (k % 6).alias("page"), named("b").alias("bid"), F.array(named("a")).alias("aliases"), named("h", k % 200).alias("head"), named("the words of ").alias("text"))
    n = o.select(
        k.alias("id"), F.col("o_custkey").alias("docHash"), ((k + 1) % 6).alias("page"), F.when(k % 5 == 0, named("b")).when(k % 5 == 1, named("a")).otherwise("none").alias("bid"),
        F.when(k % 5 == 2, named("h", k % 200)).otherwise("").alias("srcHead"), F.when(k % 5 == 3, named("words of ")).otherwise("").alias("quote"),
    )
    return n, b


@query(f"WITH {_NOTES} SELECT id, found AS anchored, there AS anchored_page, status FROM m")
def note_anchors(spark, sf_dir):
    return match.anchor_blocks(*_anchors(spark, sf_dir)).select("id", "anchored", "anchored_page", "status")


@query(f"WITH {_NOTES} SELECT id, CASE WHEN status = 'lost' AND doc % 3 <> 0 THEN 'pending' ELSE status END AS status, coalesce(status <> 'lost' AND (found <> bid OR there <> page), false) AS drift FROM m")
def notes_reanchored(spark, sf_dir):
    n, b = _anchors(spark, sf_dir)
    return match.reanchor(n, b, n.where("docHash % 3 = 0").select("docHash", "page")).select("id", "status", "drift")


@query(
    f"""WITH {BLOCKS}, h AS (SELECT doc_id AS doc, ord, lower({sql_collapse("text")}) AS t FROM blocks WHERE length(text) <= 60), e AS (SELECT doc, ord, t FROM h WHERE ord % 2 = 0)
    SELECT e.doc, e.ord, min(h.ord) AS heading FROM e LEFT JOIN h ON e.doc = h.doc AND e.t = h.t GROUP BY ALL"""
)
def headings_matched(spark, sf_dir):
    own = blocks(spark, sf_dir).where("length(text) <= 60").select(F.col("doc_id").alias("doc"), "ord", F.col("text").alias("title"), F.lit(1).alias("page"), F.col("ord").alias("id"))
    entries = own.where("ord % 2 = 0").select("doc", "ord", F.concat(F.lit("2.1  "), "title").alias("title"), F.lit(None).cast("int").alias("page"))
    return match.match_headings(entries, own).select("doc", "ord", "heading")


@query(f"WITH {BLOCKS} SELECT doc_id AS doc, coalesce(arg_max(text, ord) FILTER (WHERE ord * 10 <= 45), arg_min(text, ord)) AS title FROM blocks GROUP BY doc_id")
def current_entries(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("doc"), "ord", F.col("text").alias("title"), (F.col("ord") * 10.0).alias("y"))
    return layout.current_entry(own, 45.0)


@query("SELECT o_custkey AS doc, 1 AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_orderstatus AS title FROM orders UNION ALL SELECT o_custkey, 2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, o_orderpriority FROM orders")
def outlines_flat(spark, sf_dir):
    """Each order is an entry with one entry below it."""
    below = F.array(F.struct(F.col("o_orderpriority").alias("title"), F.lit(2).alias("page")))
    entry = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("title"), F.lit(1).alias("page"), below.alias("items"))
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return layout.flatten_outline(own).select("doc", "level", F.col("path")[0].cast("long").alias("k"), "title")


_MARKED = "CASE WHEN ord % 9 = 7 THEN 'References' WHEN ord % 9 = 1 THEN 'Appendix A' ELSE text END"


@query(
    f"""WITH {BLOCKS}, m AS (SELECT doc_id, ord, CASE WHEN ord % 9 = 7 THEN true WHEN ord % 9 = 1 THEN false END AS mark FROM blocks)
    SELECT doc_id AS doc, ord, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), false) AS skip FROM m"""
)
def references_skipped(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "ord", F.expr(_MARKED).alias("text"), F.lit("heading").alias("label"))
    return layout.relabel_references(own).select("doc", "ord", "skip")


@query(
    f"""WITH {BLOCKS}, s AS (SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN '1.2 ' || trim(text) WHEN 1 THEN 'IV. ' || trim(text) ELSE 'x ' || trim(text) END AS t FROM blocks WHERE ord < 1000000)
    SELECT doc_id AS doc, ord, {sql_collapse("t")} AS title, CASE ord % 3 WHEN 0 THEN '1.2' WHEN 1 THEN 'IV' END AS number, CASE ord % 3 WHEN 0 THEN 2 ELSE 1 END AS level FROM s"""
)
def outline_levels(spark, sf_dir):
    t = F.expr("case ord % 3 when 0 then '1.2 ' || trim(text) when 1 then 'IV. ' || trim(text) else 'x ' || trim(text) end")
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "ord", t.alias("text"), F.lit("heading").alias("label"))
    return layout.outline(own).drop("page")


@query(
    f"""WITH {BLOCKS}, r AS (SELECT doc_id, ord, lower({sql_collapse("text")}) AS t, text FROM blocks), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY ord) AS k FROM r)
    SELECT doc_id AS page, ord FROM k WHERE k = 1 OR length(t) < 24"""
)
def swapped_dropped(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("page"), "ord", "text")
    return match.drop_swapped(own).select("page", "ord")


@query("SELECT l_orderkey AS page, count(*) FILTER (WHERE mo < b) AS inversions, count(*) FILTER (WHERE mo < b) > 0 AS off FROM (SELECT l_orderkey, l_partkey AS mo, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) GROUP BY l_orderkey")
def orders_off(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey").alias("to"), F.col("l_partkey").alias("mo"))
    return match.order_off(own)


@query(
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, ord, {sql_collapse("text")} AS t FROM blocks), m AS (SELECT doc_id, ord, substr(t, 1, 24) AS head FROM t WHERE ord % 2 = 1)
    SELECT m.doc_id AS page, m.ord AS id, min(t.ord)::DOUBLE AS top FROM m LEFT JOIN t ON t.doc_id = m.doc_id AND t.ord % 4 < 3 AND contains(t.t, m.head) GROUP BY ALL"""
)
def boxes_donated(spark, sf_dir):
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("page"), F.col("ord").alias("id"), "ord", "text", geometry.box(F.lit(0.0), F.col("ord").cast("double"), F.lit(1.0), F.col("ord") + 1.0).alias("box"))
    model = own.where("id % 2 = 1").withColumn("box", F.when(F.lit(False), F.col("box")))
    return match.donate_boxes(model, own.where("ord % 4 < 3")).select("page", "id", F.col("box.y0").alias("top"))


def _align_sql(x: str, y: str) -> str:
    return f"""WITH {BLOCKS}, l AS (SELECT doc_id, ord, {sql_collapse("text")} AS t FROM blocks WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')),
    p AS (SELECT a.doc_id, a.ord AS tid, b.ord AS mid, CASE WHEN a.ord = b.ord THEN 2.0 ELSE 0.0 END + 1 - CASE WHEN lower(a.t) = lower(b.t) THEN 0.0 ELSE levenshtein({x}, {y}) * 1.0 / greatest(length(a.t), length(b.t)) END AS s
      FROM l a JOIN l b ON a.doc_id = b.doc_id WHERE b.ord % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tid ORDER BY s DESC, mid) AS k FROM p WHERE s >= 0.45)"""


def _ascii_lines(lines):
    """Lines in plain ASCII, as the oracle counts bytes; every second one is also a block of the model."""
    own = lines.where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return own.select(F.col("doc_id").alias("page"), F.col("ord").alias("id"), "ord", "text", geometry.box(F.lit(0.0), F.col("ord") * 10.0, F.lit(9.0), F.col("ord") * 10.0 + 9).alias("box"))


@query(f"{_align_sql('lower(a.t)', 'lower(b.t)')} SELECT doc_id AS page, tid, mid, s AS score FROM r WHERE k = 1")
def blocks_aligned(spark, sf_dir):
    own = _ascii_lines(blocks(spark, sf_dir))
    return match.align_blocks(own.where("ord % 2 = 0"), own, first=None)


@query(f"{_align_sql('substr(lower(a.t), 1, 400)', 'substr(lower(b.t), 1, 400)')} SELECT doc_id AS page, ord AS id FROM l WHERE (doc_id, ord) NOT IN (SELECT (doc_id, tid) FROM r)")
def blocks_unmatched(spark, sf_dir):
    own = _ascii_lines(blocks(spark, sf_dir, dealt=True)).withColumn("model", F.col("ord") % 2 == 0).withColumn("layer", F.lit(True))
    return match.unmatched_blocks(own)


# --- pages ----------------------------------------------------------------------------------------


@query("SELECT page, band, row_number() OVER (ORDER BY band, abs(page - 40), page) AS place FROM (SELECT DISTINCT o_orderkey % 90 AS page, CASE WHEN o_orderkey % 90 = 40 THEN 0 WHEN abs(o_orderkey % 90 - 40) <= 2 THEN 1 ELSE 2 END AS band FROM orders)")
def page_schedule(spark, sf_dir):
    from pyspark.sql import Window

    own = layout.page_schedule(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 90).alias("page")).distinct(), 40)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.monotonically_increasing_id()))
    return own.select("page", "band", place.cast("long").alias("place"))


@query(
    f"""WITH {BLOCKS}, p AS (SELECT DISTINCT doc_id, ord // 40 + 1 AS page FROM blocks), l AS (SELECT doc_id, page, -1 AS id, 'page:' || page || ':612x792' AS line FROM p UNION ALL SELECT doc_id, ord // 40 + 1, ord, text || chr(9) || '72,' || ord * 12 || '.25' FROM blocks)
    SELECT doc_id AS doc, sha256('pages:' || count(*) FILTER (WHERE id = -1) || chr(10) || string_agg(line, chr(10) ORDER BY page, id)) AS fingerprint FROM l GROUP BY doc_id"""
)
def content_fingerprints(spark, sf_dir):
    own = blocks(spark, sf_dir).select(
        F.col("doc_id").alias("doc"), F.floor(F.col("ord") / 40 + 1).alias("page"), F.col("ord").alias("id"), F.col("text").alias("str"), F.lit(72.0).alias("x"), (F.col("ord") * 12 + 0.25).alias("y")
    )
    pages = own.select("doc", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    return layout.content_fingerprint(pages, own)


@query(
    f"""WITH {BLOCKS}, s AS (SELECT doc_id, ord, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS seed FROM blocks), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seed ORDER BY ord) AS k FROM s)
    SELECT doc_id AS doc, ord, CASE WHEN seed = '' THEN 'kept' WHEN k = 1 THEN 'plain' ELSE k::VARCHAR END AS suffix, CASE WHEN seed = '' THEN 0 ELSE 1 END AS aliases FROM k"""
)
def ids_restamped(spark, sf_dir):
    """What an id ends in, as SQL has no FNV; every old id becomes an alias."""
    seed = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))
    own = blocks(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "ord", "text", F.lit("old").alias("bid"), F.array().cast("array<string>").alias("aliases"), geometry.box(F.lit(0.0), F.col("ord") * 1.0, F.lit(1.0), F.col("ord") + 1.0).alias("box"))
    out = layout.restamp(own, seed)
    suffix = F.when(F.col("bid") == "old", "kept").when(F.col("bid").contains("-"), F.regexp_extract("bid", "-([0-9]+)$", 1)).otherwise("plain")
    return out.select("doc", "ord", suffix.alias("suffix"), F.size("aliases").alias("aliases"))


@query()
def column_gutters(spark, sf_dir):
    from .layout_queries import items

    return layout.column_gutters(items(spark, sf_dir).withColumn("str", F.concat("str", F.lit(" "))))


@query("SELECT page_id, regexp_matches(url, '\\.(com|org)/') AS chrome, length(coalesce(html, '')) > 0 AS any_html FROM pages")
def chrome_classes(spark, sf_dir):
    """Class names made of the URL's kind."""
    name = F.when(F.col("url").rlike(r"\.(com|org)/"), "page-nav top").otherwise("content")
    return table(spark, sf_dir, "pages").select("page_id", web.class_is_chrome(name).alias("chrome"), (F.length(text.text("html")) > 0).alias("any_html"))
