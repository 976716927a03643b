"""Queries that apply the column functions on text to the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, redact, text
from ..operators import match
from .document_queries import BLOCKS, WS, blocks, sql_collapse
from .registry import query, table

_T = f"t AS (SELECT doc_id, ord, text, {sql_collapse('text')} AS c FROM blocks)"


def _lines(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "ord", "text", text.collapse("text").alias("c"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, array_to_string(list_filter(string_split(regexp_replace(c, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), '|') AS sentences FROM t"""
)
def line_sentences(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "ord", F.array_join(text.sentences("text"), "|").alias("sentences"))


@query(
    f"""WITH {BLOCKS}, {_T}, m AS (SELECT doc_id, ord, c, c <> '' AND length(c) <= 160 AND (regexp_matches(c, '{text.OPEN_ACCESS_LINE}') OR regexp_matches(c, '{text.DOI_LINE}') OR regexp_matches(c, '{text.ISSN_LINE}') OR regexp_matches(c, '{text.ARTICLE_TYPE}')
      OR regexp_matches(c, '{text.JOURNAL_BANNER}') OR (regexp_matches(c, '{text.VOLUME_LINE}') AND length(c) < 80) OR (regexp_matches(c, '{text.COPYRIGHT_LINE}') AND length(c) < 120)) AS meta FROM t)
    SELECT doc_id, ord, meta, regexp_matches(c, '{text.SECTION_HEADING}') AS section FROM m"""
)
def metadata_lines(spark, sf_dir):
    """Every fifth line is replaced by one of a journal's furniture."""
    own = _lines(spark, sf_dir)
    return own.select("doc_id", "ord", text.is_metadata("text").alias("meta"), text.is_section_heading("text").alias("section"))


_SHAPED = "CASE ord % 8 WHEN 0 THEN '12' WHEN 1 THEN 'arXiv:1706.03762v5 [cs.CL]' WHEN 2 THEN 'Preprint. Under review' WHEN 3 THEN 'Open Access' WHEN 4 THEN 'Ada Lovelace and Alan Turing' WHEN 5 THEN 'ada@example.org' WHEN 6 THEN 'Proceedings of the workshop 2020' ELSE c END"


def _shaped(spark, sf_dir):
    """Lines of which seven in eight are furniture of a page."""
    return _lines(spark, sf_dir).withColumn("s", F.expr(_SHAPED))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, {_SHAPED} AS s FROM t)
    SELECT doc_id, ord, trim(s) = '' OR regexp_matches(trim(s), '{text.PAGE_NUMBER}') OR regexp_matches(regexp_replace(s, '{WS}', '', 'g'), '{text.DECORATIVE}') OR regexp_matches({sql_collapse("trim(s)")}, '{text.OPEN_ACCESS_LINE}') OR regexp_matches(trim(s), '{text.ARXIV_STAMP}')
      OR regexp_matches(trim(s), '(?i)^https?://arxiv\\.org') OR regexp_matches(trim(s), '{text.PERMISSION}') OR (regexp_matches(trim(s), '(?i)^preprint\\b') AND length(trim(s)) < 48) AS chrome FROM s"""
)
def page_chrome(spark, sf_dir):
    return _shaped(spark, sf_dir).select("doc_id", "ord", text.is_page_chrome("s").alias("chrome"))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, {_SHAPED} AS s, ord % 30 AS k FROM t)
    SELECT doc_id, ord, CASE ord % 8 WHEN 0 THEN k * 27 < 792 * 0.07 OR k * 27 > 792 * 0.93 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true
      WHEN 6 THEN (792 - k * 27 - 9 < 792 * 0.07 OR k * 27 < 792 * 0.075) OR (792 - k * 27 - 9 >= -2 AND 792 - k * 27 - 9 < 792 * 0.08) END AS chrome
    FROM s WHERE ord % 8 IN (0, 1, 2, 3, 6)"""
)
def page_chrome_items(spark, sf_dir):
    """Furniture at thirty heights of a page: numbers and venues count only at its edges."""
    own = _shaped(spark, sf_dir).where("ord % 8 in (0, 1, 2, 3, 6)")
    y = (F.col("ord") % 30) * 27.0
    test = text.is_page_chrome_item(F.col("s"), F.lit(200.0), y, F.lit(9.0), F.lit(792.0), F.lit(612.0))
    return own.select("doc_id", "ord", test.alias("chrome"))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, {_SHAPED} AS s FROM t), w AS (SELECT *, list_filter(regexp_split_to_array(trim(s), '\\s+'), lambda x: x <> '') AS w FROM s)
    SELECT doc_id, ord, CASE WHEN trim(s) = '' OR length(trim(s)) > 200 OR regexp_matches(trim(s), '(?i)^(abstract|introduction|conclusion|references|acknowledgements?|related work)$') THEN false
      WHEN contains(s, '@') OR regexp_matches(trim(s), '(?i)^(google|university|openai|deepmind|microsoft|facebook|meta|stanford|mit|berkeley|research)\\b') THEN true
      WHEN regexp_matches(trim(s), '[.!?]') AND length(trim(s)) > 40 THEN false
      ELSE (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Za-z.`''\\-]*$'))) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Za-z.`''\\-]*$'))) >= len(w) * 0.7 AND len(w) <= 24)
        OR (len(w) <= 6 AND regexp_matches(trim(s), '^[A-Z]') AND NOT regexp_matches(trim(s), '[.!?]$')) END AS author FROM w"""
)
def author_lines(spark, sf_dir):
    return _shaped(spark, sf_dir).select("doc_id", "ord", text.looks_like_author("s").alias("author"))


_FONTS = "CASE l_linenumber WHEN 1 THEN 'CMMI10' WHEN 2 THEN 'CMTT9' WHEN 3 THEN 'Times-Roman' WHEN 4 THEN 'Courier-Bold' WHEN 5 THEN 'EuclidSymbol' ELSE '' END"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber IN (1, 5) AS math, l_linenumber IN (2, 4) AS code FROM (SELECT *, {_FONTS} AS f FROM lineitem)")
def type_faces(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("f", F.expr(_FONTS))
    return own.select("l_orderkey", "l_linenumber", text.is_math_face("f").alias("math"), text.is_code_face("f").alias("code"))


_SAID = "CASE ord % 5 WHEN 0 THEN '译文' || c WHEN 1 THEN ' ' || c WHEN 2 THEN 'mots latins' WHEN 3 THEN 'ひらがな' ELSE ' ' END"


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, c, {_SAID} AS s FROM t), e AS (SELECT *, ord % 5 = 1 AND c <> '' AS echo FROM s)
    SELECT doc_id, ord, ord % 5 = 0 AS han, ord % 5 IN (0, 3) AS ja, (ord % 5 = 2 OR ord % 5 = 3 OR (ord % 5 = 1 AND NOT echo AND regexp_matches(s, '\\p{{L}}'))) AND lower(s) <> lower(c) AS latin, echo,
      echo AND (len(string_split(c, ' ')) <= 3 OR NOT regexp_matches(s, '\\p{{L}}')) AS unchanged_ok FROM e"""
)
def translations_landed(spark, sf_dir):
    own = _lines(spark, sf_dir).withColumn("s", F.expr(_SAID))
    s, c = F.col("s"), F.col("c")
    return own.select(
        "doc_id", "ord", text.landed(s, c).alias("han"), text.landed(s, c, "ja").alias("ja"), text.landed(s, c, "latin").alias("latin"), text.is_echo(s, c).alias("echo"), text.unchanged_ok(s, c).alias("unchanged_ok")
    )


@query(f"WITH {BLOCKS}, {_T} SELECT doc_id, ord, c <> '' AND (len(string_split(c, ' ')) <= 3 OR NOT regexp_matches(c, '\\p{{L}}')) AS short FROM t")
def short_sources(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "ord", text.source_is_short("text").alias("short"))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, c || ' ⟦f' || ord % 3 || '⟧ [' || ord % 4 || ', 7]' AS src, c || ' ⟦f' || ord % 2 || '⟧ [' || ord % 5 || ', 7]' AS tr FROM t WHERE NOT regexp_matches(c, '\\[|⟦'))
    SELECT doc_id, ord, CASE WHEN ord % 3 <> ord % 2 THEN 'formula-placeholder-mismatch' WHEN ord % 4 <> ord % 5 THEN 'citation-mismatch' ELSE '' END AS integrity FROM s"""
)
def translation_integrity(spark, sf_dir):
    own = _lines(spark, sf_dir).where(~F.col("c").rlike(r"\[|⟦"))
    marked = lambda a, b: F.concat("c", F.lit(" ⟦f"), (F.col("ord") % a).cast("string"), F.lit("⟧ ["), (F.col("ord") % b).cast("string"), F.lit(", 7]"))
    return own.select("doc_id", "ord", text.translation_integrity(marked(3, 4), marked(2, 5)).alias("integrity"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, len(regexp_extract_all(c || ' 3.5 mg', '(?i)\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]|\\d+(?:\\.\\d+)?(?:\\s?(?:%|℃|°C|mg|kg|g|mm|cm|km|nm|μm|um|mL|ml|Hz|kHz|MHz|ms|min|bp|kb))?'))::INTEGER AS numbers,
      len(regexp_extract_all(c || ' [1, 2] [3]', '\\[\\s*\\d+(?:\\s*[,–-]\\s*\\d+)*\\s*\\]'))::INTEGER AS citations, len(regexp_extract_all(c || '⟦f1⟧⟦f2⟧', '⟦f\\d+⟧'))::INTEGER AS placeholders FROM t"""
)
def numbers_and_marks(spark, sf_dir):
    more = lambda s: F.concat("c", F.lit(s))
    return _lines(spark, sf_dir).select(
        "doc_id", "ord", F.size(text.numbers(more(" 3.5 mg"))).alias("numbers"), F.size(text.citations(more(" [1, 2] [3]"))).alias("citations"), F.size(text.placeholders(more("⟦f1⟧⟦f2⟧"))).alias("placeholders")
    )


@query(
    f"""WITH {BLOCKS}, l AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS t, count(*) AS n, list({sql_collapse("text")} ORDER BY ord) AS c FROM blocks GROUP BY doc_id)
    SELECT doc_id, list_reduce(list_prepend('', list_transform(c, lambda x, i: i || '. ' || x)), lambda a, b: a || b || chr(10)) AS numbered, n::INTEGER + 1 AS parsed FROM l"""
)
def numbered_lists(spark, sf_dir):
    own = blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", text.collapse("text").alias("c")))).alias("l"))
    lines = F.transform("l", lambda x: x["c"])
    numbered = text.numbered(lines)
    return own.select("doc_id", F.concat(numbered, F.lit("\n")).alias("numbered"), F.size(text.parse_numbered(numbered, F.size("l") + 1)).alias("parsed"))


_SIZES = (0, 512, 1024, 1536, 10240, 1048576, 157286400, 1073741824, 5368709120)


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '0 B' WHEN 1 THEN '512 B' WHEN 2 THEN '1 KB' WHEN 3 THEN '1.5 KB' WHEN 4 THEN '10 KB' WHEN 5 THEN '1 MB' WHEN 6 THEN '150 MB' WHEN 7 THEN '1 GB' ELSE '5 GB' END AS shown FROM orders"
)
def sizes_shown(spark, sf_dir):
    n = F.element_at(F.array(*(F.lit(x).cast("long") for x in _SIZES)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.approx_bytes(n).alias("shown"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, CASE ord % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'table' END AS kind, CASE ord % 4 WHEN 0 THEN ord || 'b' WHEN 1 THEN ord::VARCHAR WHEN 2 THEN ord::VARCHAR END AS num FROM t WHERE ord % 4 <> 3"""
)
def figure_labels(spark, sf_dir):
    own = _lines(spark, sf_dir).where("ord % 4 <> 3")
    k = F.col("ord").cast("string")
    caption = F.when(F.col("ord") % 4 == 0, F.concat(F.lit("Fig. "), k, F.lit("b: "), "c")).when(F.col("ord") % 4 == 1, F.concat(F.lit("TABLE "), k, F.lit(". "), "c")).otherwise(F.concat(F.lit(" 表"), k, F.lit(" "), "c"))
    return own.select("doc_id", "ord", text.figure_label(caption).alias("l")).select("doc_id", "ord", "l.kind", "l.num")


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '1706.0' || 3000 + o_orderkey % 1000 WHEN 1 THEN 'hep-th/9901' || 100 + o_orderkey % 900 WHEN 2 THEN '2001.0' || 1000 + o_orderkey % 1000 WHEN 3 THEN NULL ELSE '2001.00001' END AS arxiv,
      CASE o_orderkey % 5 WHEN 0 THEN 'v2' WHEN 4 THEN 'v12' END AS version FROM orders"""
)
def preprint_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    n = lambda base, m: (base + k % m).cast("string")
    url = (
        F.when(k % 5 == 0, F.concat(F.lit("https://arxiv.org/pdf/1706.0"), n(3000, 1000), F.lit("v2.pdf"))).when(k % 5 == 1, F.concat(F.lit("arXiv: hep-th/9901"), n(100, 900)))
        .when(k % 5 == 2, F.concat(F.lit("http://www.arxiv.org/abs/2001.0"), n(1000, 1000), F.lit("?x=1#y"))).when(k % 5 == 3, "https://example.org/2001.00001").otherwise(" 2001.00001V12 ")
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), ids.arxiv_id(url).alias("a")).select("id", F.col("a.id").alias("arxiv"), "a.version")


@query(
    """SELECT o_orderkey AS id, o_orderkey % 6 IN (0, 1, 2) AS secret FROM orders"""
)
def secret_fields(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    key = F.element_at(F.array(*map(F.lit, ["api_key", "Client-Secret", "token", "token", "title", "keyboard"])), (k + 1).cast("int"))
    parent = F.when(k == 2, "OAuth").otherwise("body")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), redact.is_secret_key(key, parent).alias("secret"))


@query(
    """SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"nested":{"title":"' || o_orderstatus || '","auth":{"kind":"x"}},"list":[{"a":1}]}' AS json, 'abcdef' || o_orderkey || ',token-' || o_orderkey AS found FROM orders"""
)
def secrets_stripped(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    raw = F.concat(
        F.lit('{"id":'), k, F.lit(',"nested":{"title":"'), "o_orderstatus", F.lit('","apiKey":"abcdef'), k, F.lit('","auth":{"kind":"x","token":"t"}},"list":[{"a":1,"accessToken":"token-'), k, F.lit('"}]}')
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), redact.strip_secrets(raw).alias("json"), F.array_join(redact.secret_values(raw), ",").alias("found"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ftp:' WHEN page_id % 3 = 1 THEN '' ELSE 'https://host.example/a/b' END AS scrubbed, 'failed at https://host.example with ***' AS said FROM pages"""
)
def event_urls(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, "ftp://host/file").when(k % 3 == 1, "no url").otherwise("HTTPS://user:pw@HOST.example/a/b?token=1#x")
    said = redact.scrub_message(F.lit("failed at https://u:p@host.example/x?key=1 with my-secret-value"), ["my-secret-value"])
    return table(spark, sf_dir, "pages").select("page_id", redact.scrub_event_url(url).alias("scrubbed"), said.alias("said"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, regexp_replace(c, '[\\s,.;:，。；]+$', '') AS bare, 'x = y' AS equation, 'a \\leq \\pi' AS latex FROM t"""
)
def latex_tidied(spark, sf_dir):
    own = _lines(spark, sf_dir)
    eq = F.when(F.col("ord") % 2 == 0, r"x = y \tag{3a}").otherwise(" x = y  (12)")
    return own.select("doc_id", "ord", text.strip_end_punctuation("c").alias("bare"), text.strip_equation_number(eq).alias("equation"), F.regexp_replace(text.recover_latex(F.lit("a ≤ π")), r"\s+", " ").alias("latex"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS flow, {sql_collapse("regexp_replace(text, '[{}~\\\\]', ' ', 'g')")} AS plain
    FROM t WHERE NOT regexp_matches(text, '[$%\\\\]')"""
)
def latex_plain(spark, sf_dir):
    own = _lines(spark, sf_dir).where(~F.col("text").rlike(r"[$%\\]"))
    wrapped = F.concat(F.lit(r"\textbf{"), "text", F.lit(r"} \cite[p.~2]{key} $x^2$ % note"))
    return own.select("doc_id", "ord", text.flow_text("text").alias("flow"), text.plain_latex(wrapped).alias("plain"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n')) AS p FROM documents WHERE NOT regexp_matches(text, '[$%\\\\{{}}~]'))
    SELECT doc_id, count(*) FILTER (WHERE len(list_filter(string_split(trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) >= 8)::INTEGER AS paragraphs FROM l GROUP BY doc_id"""
)
def latex_paragraphs(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[$%\\{}~]"))
    source = F.concat(F.lit("\\begin{figure}\nnot these words of a figure at all in any way\n\\end{figure}\n\n"), F.replace(text.text("text"), F.lit("\n"), F.lit("\n\n")))
    return own.select("doc_id", F.size(text.latex_paragraphs(source)).alias("paragraphs"))


@query(
    f"""WITH {BLOCKS}, {_T} SELECT doc_id, ord, '√2 ' || c || ' (x)' AS clean FROM t WHERE NOT regexp_matches(c, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]') AND NOT regexp_matches(c, '{text.INVISIBLE}') AND NOT regexp_matches(c, '{text.RADICAL}|ð|(?i)a1{{4}}')
      AND NOT regexp_matches(c, '(?i)\\b(?:' || '{"|".join(b.replace(" ", chr(92) + "s") for b, _ in text.LIGATURE_HOLES)}' || ')\\b')"""
)
def blocks_sanitized(spark, sf_dir):
    """Clean lines between a damaged radical, invisible characters and a damaged bracket."""
    own = _lines(spark, sf_dir).where(~F.col("c").rlike(text.PRIVATE_USE) & ~F.col("c").rlike(text.INVISIBLE) & ~F.col("c").rlike(f"{text.RADICAL}|ð|(?i)a1{{4}}") & ~F.col("c").rlike("(?i)" + text.HOLES))
    return own.select("doc_id", "ord", text.sanitize_block(F.concat(F.lit("p\ufb03"), F.lit("2\u200b "), "c", F.lit(" ðxÞ"))).alias("clean"))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, lower(c) AS low FROM t), k AS (SELECT doc_id, low, min(ord) AS first FROM s GROUP BY ALL)
    SELECT doc_id, array_to_string(list(low ORDER BY first), '|') AS lines, count(*)::INTEGER AS n FROM k GROUP BY doc_id"""
)
def lines_unique(spark, sf_dir):
    own = blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", text.collapse("text").alias("c")))).alias("l"))
    kept = text.unique_keep_order(F.transform("l", lambda x: x["c"]))
    return own.select("doc_id", F.lower(F.array_join(kept, "|")).alias("lines"), F.size(kept).alias("n"))


@query(
    f"""WITH {BLOCKS}, {_T}, s AS (SELECT doc_id, ord, list_distinct(list_filter(string_split(c, ''), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS a, list_distinct(list_filter(string_split(reverse(c) || 'zq', ''), lambda x: NOT regexp_matches(x, '^\\s*$'))) AS b FROM t)
    SELECT doc_id, ord, len(a) * 1.0 / len(list_distinct(list_concat(a, b))) AS jaccard, len(a) = len(list_distinct(list_concat(a, b))) AS same FROM s WHERE len(a) > 0"""
)
def charsets_compared(spark, sf_dir):
    """Each line against its characters with z and q added."""
    own = _lines(spark, sf_dir).withColumn("more", F.concat(F.reverse("c"), F.lit("zq")))
    out = own.select("doc_id", "ord", match.charset_jaccard(F.col("c"), F.col("more")).alias("jaccard"), match.same_set(match.chars_of("c"), match.chars_of("more")).alias("same"), F.size(match.chars_of("c")).alias("n"))
    return out.where("n > 0").drop("n")
