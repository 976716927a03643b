"""Queries on documents, pages and labels: text functions, redaction, ids, scorecards, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import ids, redact, text
from ..operators import sample, score, web
from .registry import query, table

WS = text.WS


def sql_collapse(x: str) -> str:
    """SQL of collapsed white space."""
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


BLOCKS = f"""
blocks AS (
  SELECT doc_id, ord, line AS text FROM (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts)))::INTEGER AS ord
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  ) WHERE {sql_collapse("line")} <> ''
)"""


def blocks(spark, sf_dir, dealt=False):
    """Non-blank lines of documents: doc_id, ord, text; ``dealt`` by document first, for work that goes by documents or costs much a line."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = (d.repartition("doc_id") if dealt else d).select("doc_id", F.posexplode(F.split(text.text("text"), "\n", -1)).alias("ord", "text"))
    return d.where(text.collapse("text") != "")


@query(
    """
    WITH p AS (SELECT lang, source, count(*) AS pages, count(l.doc_id) AS units, coalesce(sum(quality), 0)::BIGINT AS correct, coalesce(sum(toxic), 0)::BIGINT AS conflicts, sum(n_chars)::BIGINT AS "svgBytes"
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang, source),
    g AS (SELECT CASE WHEN GROUPING(lang) = 0 THEN 'field' ELSE 'sourceType' END AS grouped_by, coalesce(lang, source) AS value, sum(pages)::BIGINT AS pages, sum(units)::BIGINT AS units, sum(correct)::BIGINT AS correct,
                 sum(conflicts)::BIGINT AS conflicts, sum("svgBytes")::BIGINT AS "svgBytes" FROM p GROUP BY GROUPING SETS ((lang), (source)))
    SELECT *, CASE WHEN units = 0 THEN 0.0 ELSE floor(correct * 1.0 / units * 1000 + 0.5) / 1000 END AS exact FROM g
    """
)
def scorecard_grouping_sets(spark, sf_dir):
    """Labels stand in for pages that were checked: good ones are correct units, toxic ones conflicts, characters bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    none = lambda c: F.coalesce(c, F.lit(0))
    own = d.join(l, d.doc_id == l.l_id, "left").select(
        F.col("lang").alias("field"), F.col("source").alias("sourceType"), F.lit(1).alias("pages"), F.when(F.col("l_id").isNotNull(), 1).otherwise(0).alias("units"),
        none("quality").alias("correct"), none("toxic").alias("conflicts"), F.col("n_chars").alias("svgBytes"), F.lit(0.0).alias("jaccard"),
    )
    papers = score.paper_scores(own, ["field", "sourceType"]).drop("jaccardSum")
    return score.grouped_scores(papers)


@query(
    f"""
    WITH parts AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS p,
                          unnest(range(len(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')))) AS k FROM documents),
    own AS (SELECT doc_id, k, {sql_collapse("p")} AS segment FROM parts)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS ord, segment FROM own WHERE length(segment) > 1
    """
)
def segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.segments("text")).alias("ord", "segment"))


@query(
    f"""
    WITH own AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(13), ''), '\\n+'),
                 lambda x: {sql_collapse("x")}), lambda x: x <> '')[1:3], ' ') AS t FROM documents),
    cut AS (SELECT doc_id, t, substr(t, 1, 220) AS c FROM own)
    SELECT doc_id, CASE WHEN length(t) > 220 THEN trim(CASE WHEN regexp_extract(c, '^[\\s\\S]*?[.!?。！？]') <> '' THEN regexp_extract(c, '^[\\s\\S]*?[.!?。！？]') ELSE c END)
           ELSE t END AS preview FROM cut
    """
)
def preview_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


@query(
    f"""
    WITH {BLOCKS},
    tagged AS (SELECT *, CASE WHEN length(text) <= 40 THEN 'h2' ELSE 'p' END AS tag FROM blocks),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN tag = 'h2' THEN 1 ELSE 2 END, ord) AS hk FROM tagged),
    r AS (SELECT *, hk = 1 AND tag = 'h2' AS is_h FROM h),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN is_h THEN 2 WHEN tag = 'p' THEN 0 ELSE 1 END, ord) AS bk FROM r)
    SELECT doc_id, ord, tag, text FROM b WHERE is_h OR bk = 1
    """
)
def title_and_lead(spark, sf_dir):
    own = blocks(spark, sf_dir).withColumn("tag", F.when(F.length("text") <= 40, "h2").otherwise("p"))
    return web.limit_blocks(own, "preview", "doc_id").select("doc_id", "ord", "tag", "text")


def _n(pattern: str, column: str = "t") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


_HOLES = "|".join(b.replace(" ", r"\s") for b, _ in text.LIGATURE_HOLES)
_LINES = "regexp_split_to_array(t, '\\n+')"
_BARE = f"regexp_replace(x, '{WS}', '', 'g')"


@query(
    f"""
    WITH own AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, {_n(text.SLOT)} AS a,
      {_n(text.ONES_RULE)} + {_n(text.DOT_RULE)} + len(list_filter({_LINES}, lambda x: regexp_matches({_BARE}, '{text.DECORATIVE}')
        AND NOT regexp_matches(x, '{text.ONES_RULE}') AND NOT regexp_matches(x, '{text.DOT_RULE}'))) AS b,
      {_n(text.THORN)} + {_n(text.RADICAL)} + {_n(text.QUARTER_EQUALS)} + {_n(text.PRIVATE_USE + "+")}
      + len(list_filter(regexp_extract_all(t, '(?i)\\b(?:{_HOLES})\\b'), lambda x: NOT (length(regexp_replace(x, '[^A-Za-z]', '', 'g')) <= 4
        AND regexp_replace(x, '[^A-Za-z]', '', 'g') = upper(regexp_replace(x, '[^A-Za-z]', '', 'g'))))) AS c,
      {_n(text.INVISIBLE)} AS r2
    FROM own
    """
)
def leak_counts(spark, sf_dir):
    own = text.leak_counts("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in own.items()))


_T = sql_collapse("x")
_ANY = " OR ".join(f"regexp_matches({_T}, '{p}')" for p in (text.OPEN_ACCESS_LINE, text.DOI_LINE, text.ISSN_LINE, text.ARTICLE_TYPE, text.JOURNAL_BANNER))
_META = f"""(length({_T}) <= 160 AND ({_ANY} OR (regexp_matches({_T}, '{text.VOLUME_LINE}') AND length({_T}) < 80)
  OR (regexp_matches({_T}, '{text.COPYRIGHT_LINE}') AND length({_T}) < 120)))"""


@query(
    f"""
    SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\n+'), lambda x: {_T} <> '' AND NOT regexp_matches({_T}, '{text.SECTION_HEADING}')
      AND (regexp_matches({_T}, '{text.PAGE_FURNITURE}') OR {_META}) AND NOT regexp_matches({_BARE}, '{text.DECORATIVE}'))) AS noise FROM documents
    """
)
def noise_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.noise_count("text").cast("long").alias("noise"))


_PRINTABLE = r"[\x{0020}-\x{007E}\x{00A0}-\x{024F}\x{0370}-\x{03FF}\x{4E00}-\x{9FFF}]"


@query(
    f"""
    WITH own AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, CASE WHEN {sql_collapse("t")} = '' THEN 'empty'
      WHEN {_n(text.PRIVATE_USE)} * 1.0 / length(t) > 0.05 OR {_n(_PRINTABLE)} * 1.0 / length(t) < 0.6 THEN 'garbled' ELSE 'text-layer' END AS trust FROM own
    """
)
def text_trust(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.trust("text").alias("trust"))


def _redact_sql(t: str) -> str:
    keys = r"(?i)([?&#](?:x[-_]?api[-_]?key|api[-_]?key|access[-_]?(?:token|key)|token|secret|key)=)[^&\s#]+"
    for p, r in ((r"//[^/\s@]*:[^/\s@]+@", "//***:***@"), (r"sk-[A-Za-z0-9_-]+", "***"), (r"(?i)\bBearer\s+\S+", "Bearer ***"), (r"(?i)\bDeepL-Auth-Key\s+\S+", "DeepL-Auth-Key ***"), (keys, r"\1***")):
        t = f"regexp_replace({t}, '{p}', '{r}', 'g')"
    return t


@query(
    f"""
    SELECT doc_id, {_redact_sql("coalesce(text, '')")} AS redacted,
      regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'sk-[A-Za-z0-9_-]+', '***', 'g'), '(?i)Bearer\\s+\\S+', '***', 'g'), '[A-Za-z0-9_-]{{20,}}', '***', 'g') AS strict
    FROM documents
    """
)
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.redact("text").alias("redacted"), redact.redact_strict("text").alias("strict"))


_SECRET = "(replace(lower(string_split({0}, '=')[1]), '-', '_') IN (" + ", ".join(f"'{k}'" for k in redact.SECRET_QUERY_KEYS) + ") OR starts_with(replace(lower(string_split({0}, '=')[1]), '-', '_'), 'x_amz_'))"


@query(
    f"""
    WITH own AS (SELECT page_id, trim(coalesce(url, '')) AS t FROM pages),
    split AS (SELECT page_id, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(t, '^[^:]*://|#.*$', '', 'g') AS rest FROM own),
    parts AS (SELECT page_id, scheme, lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', '')) AS host, regexp_extract(rest, '^[^/?]*(/[^?]*)', 1) AS path,
                     regexp_extract(rest, '\\?(.*)$', 1) AS query FROM split),
    clean AS (SELECT page_id, scheme, host,
      regexp_replace(array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: NOT (contains(string_split(s, ';')[1], '=') AND {_SECRET.format("string_split(s, ';')[1]")})),
        lambda s: array_to_string(list_concat([string_split(s, ';')[1]], list_filter(string_split(s, ';')[2:], lambda p: NOT {_SECRET.format("p")})), ';')), '/'), '/{{2,}}', '/', 'g') AS path,
      regexp_replace(array_to_string(list_filter(string_split(query, '&'), lambda p: NOT {_SECRET.format("p")}), '&'), '^&+|&+$', '', 'g') AS query FROM parts)
    SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || (CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END)
      || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) ELSE '' END AS url FROM clean
    """
)
def url_scrub(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact.scrub_url("url").alias("url"))


RULES = [(0, "www.example.org"), (1, "thhere.example.com"), (2, "example.com"), (3, "net"), (4, " ")]
_RULES = ", ".join(f"({k}, '{h}')" for k, h in RULES)


@query(
    f"""
    WITH rules AS (SELECT * FROM (VALUES {_RULES}) r(ord, host)),
    own AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages),
    hit AS (SELECT page_id, h, min(ord) AS ord FROM own LEFT JOIN (SELECT ord, regexp_replace(trim(host), '^www\\.', '') AS s FROM rules WHERE trim(host) <> '') r
            ON h = s OR ends_with(h, '.' || s) GROUP BY page_id, h)
    SELECT page_id, h AS host, hit.ord::INTEGER AS rule, rules.host AS rule_host FROM hit LEFT JOIN rules USING (ord)
    """
)
def host_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "ord int, host string")
    own = web.site_rules(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return own.select("page_id", F.col("__host").alias("host"), F.col("rule.ord").alias("rule"), F.col("rule.host").alias("rule_host"))


@query(
    f"""
    SELECT page_id, CASE WHEN regexp_matches(lower(url), '^https?://|^file:') AND (regexp_matches(regexp_replace(lower(url), '[?#].*$', ''), '\\.pdf$|arxiv\\.org/pdf/|/pdf/[^/]+$')
      OR regexp_matches(lower(url), '[?&](?:format|type)=pdf\\b')) THEN true ELSE false END AS pdf FROM pages
    """
)
def pdf_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(web.looks_like_pdf("url"), F.lit(False)).alias("pdf"))


@query()
def html_blocks(spark, sf_dir):
    return web.html_blocks(table(spark, sf_dir, "pages"))


@query()
def primary_title(spark, sf_dir):
    return web.primary_title(web.html_blocks(table(spark, sf_dir, "pages")))


_BOX = "floor(n * 0.37 * 100 + 0.5) / 100, floor(k * 1.25 * 100 + 0.5) / 100"


def _fmt(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.2f', {x}), '0+$', ''), '\\.$', '')"


_FP = (
    "concat_ws(chr(31), 'glyph', substr(text, 1, 12), 'F1', concat_ws(',', "
    + ", ".join(_fmt(x) for x in ("floor(n * 0.37 * 100 + 0.5) / 100", "0.0", "floor(n * 0.74 * 100 + 0.5) / 100", "10.0"))
    + "), '')"
)


def _elements(spark, sf_dir):
    own = blocks(spark, sf_dir).withColumn("n", (F.length("text") % 50).cast("double"))
    box = [F.col("n") * 0.37, F.lit(0.0), F.col("n") * 0.74, F.lit(10.0)]
    return own.withColumn("fp", ids.element_fingerprint(F.lit("glyph"), F.substring("text", 1, 12), F.lit("F1"), box, F.lit(""))), box


@query(
    f"""
    WITH {BLOCKS}, f AS (SELECT doc_id, ord, {_FP.replace("n *", "(length(text) % 50)::DOUBLE *")} AS fp FROM blocks),
    o AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, fp ORDER BY ord) - 1)::INTEGER AS ordinal FROM f)
    SELECT doc_id, ord, ordinal, 'e' || substr(sha256(fp || chr(31) || ordinal), 1, 16) AS id FROM o
    """
)
def element_ids(spark, sf_dir):
    own, _ = _elements(spark, sf_dir)
    w = Window.partitionBy("doc_id", "fp").orderBy("ord")
    own = own.withColumn("ordinal", F.row_number().over(w) - 1)
    return own.select("doc_id", "ord", "ordinal", ids.element_id(F.col("fp"), F.col("ordinal")).alias("id"))


@query(
    f"""
    WITH {BLOCKS}, s AS (SELECT doc_id, ord, substr(sha256('t|' || substr(regexp_replace(lower(regexp_replace(text, '⟦f\\d+⟧', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), 1, 200)), 1, 12) AS base FROM blocks),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ord) AS k FROM s)
    SELECT doc_id, ord, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS bid FROM n
    """
)
def collision_suffix(spark, sf_dir):
    base = F.substring(F.sha2(F.concat(F.lit("t|"), ids.block_text("text")), 256), 1, 12)
    own = blocks(spark, sf_dir).select("doc_id", "ord", base.alias("base"))
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ord"))
    return own.select("doc_id", "ord", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string"))).alias("bid"))


@query()
def block_ids(spark, sf_dir):
    own = blocks(spark, sf_dir).select("doc_id", "ord", F.concat(F.lit("b1-p1-t"), ids.fnv36(ids.block_seed(F.lit("t"), "text"))).alias("base"))
    k = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("ord"))
    return own.select("doc_id", "ord", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string"))).alias("bid"))


@query(
    f"""
    WITH {BLOCKS}, f AS (SELECT doc_id, ord, {_FP.replace("n *", "(length(text) % 50)::DOUBLE *")} AS fp FROM blocks),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fp ORDER BY ord) - 1 AS k FROM f),
    e AS (SELECT *, CASE WHEN ord % 13 = 5 THEN k + 1 ELSE k END AS ordinal, CASE WHEN ord % 7 = 3 THEN 'odd' ELSE 'text' END AS label FROM o),
    i AS (SELECT *, CASE WHEN ord % 11 = 2 THEN 'e0000000000000000' ELSE 'e' || substr(sha256(fp || chr(31) || ordinal), 1, 16) END AS id FROM e)
    SELECT issue, count(*) AS n FROM (
      SELECT 'label' AS issue FROM i WHERE label <> 'text'
      UNION ALL SELECT 'identity' FROM i WHERE id <> 'e' || substr(sha256(fp || chr(31) || ordinal), 1, 16)
      UNION ALL SELECT 'duplicate' FROM (SELECT doc_id, id FROM i GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT 'ordinal' FROM (SELECT ordinal, row_number() OVER (PARTITION BY doc_id, fp ORDER BY ordinal, id) - 1 AS r FROM i) WHERE r <> ordinal
    ) GROUP BY issue
    """
)
def id_integrity(spark, sf_dir):
    own, box = _elements(spark, sf_dir)
    k = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("ord")) - 1
    e = own.withColumn("k", k).withColumn("ordinal", F.when(F.col("ord") % 13 == 5, F.col("k") + 1).otherwise(F.col("k")))
    e = e.withColumn("id", F.when(F.col("ord") % 11 == 2, "e0000000000000000").otherwise(ids.element_id(F.col("fp"), F.col("ordinal"))))
    e = e.select(
        F.col("doc_id").alias("page"), "id", F.lit("glyph").alias("kind"), F.substring("text", 1, 12).alias("char"), F.lit("F1").alias("font"),
        F.array(*box).alias("bbox"), F.lit("").alias("pathHash"), "ordinal", F.when(F.col("ord") % 7 == 3, "odd").otherwise("text").alias("label"), F.lit(None).cast("string").alias("unitId"),
    )
    units = spark.createDataFrame([], "page long, id string, type string, elementIds array<string>")
    return score.label_issues(e, units).groupBy("issue").agg(F.count("*").alias("n"))


@query(
    """
    WITH u AS (SELECT doc_id, source, lang, floor(n_chars / 100) % 10 / 10.0 AS confidence FROM documents),
    s AS (SELECT source, count(*) AS n FROM u GROUP BY source),
    quota AS (
      SELECT source, least(n, lvl) AS base FROM s, (SELECT max(l) AS lvl FROM range(0, 2000) r(l), (SELECT 1) WHERE (SELECT sum(least(n, l)) FROM s) <= 150)
    ),
    rest AS (SELECT source, base, n, (SELECT 150 - sum(base) FROM quota) AS spare FROM quota JOIN s USING (source)),
    final AS (SELECT source, base + CASE WHEN n > base AND row_number() OVER (PARTITION BY n > base ORDER BY source) <= spare THEN 1 ELSE 0 END AS quota FROM rest),
    ranked AS (SELECT *, power((('0x' || substr(sha256('20260925|' || doc_id), 1, 8))::UBIGINT + 0.5) / 4294967296, 1 / greatest(0.05, 1 - confidence)) AS u FROM u),
    k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u DESC, doc_id) AS k FROM ranked)
    SELECT doc_id, source FROM k JOIN final USING (source) WHERE k <= quota
    """
)
def stratified_sample(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source", (F.floor(F.col("n_chars") / 100) % 10 / 10.0).alias("confidence"))
    return sample.stratified(own, ["source"], 150, ["doc_id"], confidence="confidence").select("doc_id", "source")


@query(
    """
    WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS a FROM documents),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY a, source) AS b FROM a)
    SELECT doc_id, b::INTEGER AS round, lang FROM b
    """
)
def interleaved_queue(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sample.review_queue(own, "lang", "source", ["n_chars", "doc_id"]).select("doc_id", F.col("queue.__b").alias("round"), F.col("queue.lang").alias("lang"))


@query(
    """
    SELECT CASE WHEN GROUPING(lang) = 0 THEN 'field' WHEN GROUPING(source) = 0 THEN 'sourceType' WHEN GROUPING(kind) = 0 THEN 'type' ELSE 'total' END AS grouped_by,
           coalesce(lang, source, kind) AS value, count(*) AS n
    FROM (SELECT lang, source, CASE WHEN n_chars > 2000 THEN 'display' ELSE 'inline' END || CASE WHEN doc_id % 3 = 0 THEN '+eq' ELSE '' END AS kind FROM documents)
    GROUP BY GROUPING SETS ((lang), (source), (kind), ())
    """
)
def composition(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("field"), F.col("source").alias("sourceType"), F.when(F.col("n_chars") > 2000, "display").otherwise("inline").alias("type"),
        (F.col("doc_id") % 3 == 0).alias("equationNumber"),
    )
    return score.composition(own)


@query(
    """
    SELECT lang, count(*) FILTER (WHERE quality = 0 OR (n_chars % 100) / 100.0 < 0.65) AS fallback, count(*) AS total,
           count(*) FILTER (WHERE quality = 0 OR (n_chars % 100) / 100.0 < 0.65) * 1.0 / count(*) AS rate
    FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """
)
def fallback_rates(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    own = own.select("lang", (F.col("quality") == 0).alias("fallback"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"))
    return score.fallback_rate(own, ["lang"])


@query(
    f"""
    WITH {BLOCKS}, own AS (SELECT doc_id, ord, {sql_collapse("text")} AS t FROM blocks),
    w AS (SELECT *, len(string_split(t, ' ')) AS n FROM own)
    SELECT doc_id, ord, CASE WHEN n <= 2 AND length(t) <= 24 THEN 'word' WHEN n <= 8 AND length(t) <= 80 THEN 'phrase' ELSE 'sentence' END AS type,
      len(regexp_extract_all(t, '[A-Za-z]{{4,}}')) >= 2 AND len(regexp_extract_all(t, '[A-Za-z]')) >= 12
        AND len(regexp_extract_all(t, '[A-Za-z]')) * 1.0 / greatest(length(t), 1) >= 0.5 AS prose,
      len(regexp_extract_all(t, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]|\\d+(?:\\.\\d+)?')) AS numbers,
      ceil(length(t) / 40.0)::BIGINT AS wrapped FROM w
    """
)
def block_features(spark, sf_dir):
    own = blocks(spark, sf_dir).withColumn("t", text.collapse("text"))
    plain = F.regexp_extract_all("t", F.lit(r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]|\d+(?:\.\d+)?"), 0)
    return own.select(
        "doc_id", "ord", text.item_type("t").alias("type"), text.looks_like_prose("t").alias("prose"), F.size(plain).cast("long").alias("numbers"),
        F.size(text.wrap("t", 40)).cast("long").alias("wrapped"),
    )


@query(
    f"""
    WITH {BLOCKS}
    SELECT doc_id, ord, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
      regexp_replace(regexp_replace(text, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]+', '⟨⋯⟩', 'g'), '{text.INVISIBLE}', '', 'g') AS clean FROM blocks
    """
)
def escaped_blocks(spark, sf_dir):
    own = blocks(spark, sf_dir)
    return own.select("doc_id", "ord", text.escape_html("text").alias("html"), text.strip_invisible(text.mark_private_use("text")).alias("clean"))


@query(
    """
    SELECT lang, count(*) AS units, sum(quality)::BIGINT AS correct, floor(sum(quality) * 1000.0 / count(*) + 0.5) / 1000 AS exact
    FROM documents JOIN labels USING (doc_id) GROUP BY lang
    """
)
def paper_scores(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    own = own.select("lang", F.lit(1).alias("units"), F.col("quality").alias("correct"), F.col("toxic").cast("double").alias("jaccard"))
    out = score.paper_scores(own, ["lang"])
    return out.select("lang", "units", "correct", score.rate(F.col("correct"), F.col("units")).alias("exact"))


@query(
    """
    SELECT source, count(*) FILTER (WHERE met) AS passed, count(*) AS total, count(*) FILTER (WHERE must AND NOT met) AS must_failed, GROUPING(source) AS overall
    FROM (SELECT source, quality = 1 AS met, toxic = 1 AS must FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (source)
    """
)
def judgment_summary(spark, sf_dir):
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = score.judgment_summary(own.select("source", (F.col("quality") == 1).alias("met"), (F.col("toxic") == 1).alias("must")))
    return out.withColumn("overall", F.col("overall").cast("long"))


@query(
    f"""
    WITH own AS (SELECT doc_id, {_redact_sql("coalesce(text, '')")} AS t, coalesce(text, '') AS raw FROM documents)
    SELECT count(*) AS docs, count(*) FILTER (WHERE t <> raw) AS changed, sum(length(raw) - length(t))::BIGINT AS removed FROM own
    """
)
def redaction_totals(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(text.text("text").alias("raw")).withColumn("t", redact.redact("raw"))
    return own.agg(F.count("*").alias("docs"), F.count_if(F.col("t") != F.col("raw")).alias("changed"), F.sum((F.length("raw") - F.length("t")).cast("long")).alias("removed"))


@query()
def leak_bar(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper"), "text")
    scan = score.leak_scan(own, F.col("text"), text.sanitize_block("text"))
    return score.leak_bar(scan, own)


def total(columns: dict[str, Column]) -> Column:
    return reduce(Column.__add__, columns.values())
