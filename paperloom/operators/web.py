"""Blocks of web pages, site rules and chrome."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse, text

# --- fixed values ---------------------------------------------------------------------------------
BLOCK_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "td", "th", "dd", "dt", "figcaption", "summary", "caption")
SKIP_TAGS = ("script", "style", "noscript", "template", "code", "pre", "kbd", "svg", "math", "textarea", "select", "button", "iframe", "head")
MAIN_TAGS, SIDE_TAGS = ("main", "article"), ("aside", "nav", "footer", "header")
CHROME_CLASSES = r"(?i)(?:^|[\s_-])(?:nav|navbar|menu|sidebar|footer|header|breadcrumb|cookie|banner|toolbar|share|social|advert|ad|ads|promo)(?:$|[\s_-])"
CHROME_META = r"(?i)^(?:\d+\s*(?:min(?:ute)?s?\s+read|comments?|views?|likes?)|share|follow|sign (?:in|up)|log ?in|subscribe|menu|advertisement|read more)\b"
VOID = ("br", "hr", "img", "input", "meta", "link", "wbr", "source", "col", "area", "base", "embed", "track", "param")
# --------------------------------------------------------------------------------------------------


class _Collector(HTMLParser):
    """Innermost block elements in order, with the region that they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: list[dict] = []
        self.out: list[dict] = []
        self.chrome = 0
        self.title = ""

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if self.open and tag == "br":
                self.open[-1]["text"] += " "
            return
        cls = dict(attrs).get("class") or ""
        self.stack.append(tag + ("!" if re.search(CHROME_CLASSES, cls) else ""))
        if tag in BLOCK_TAGS and not any(t.rstrip("!") in SKIP_TAGS for t in self.stack):
            if self.open:
                self.open[-1]["nested"] = True
            own = {t.rstrip("!") for t in self.stack}
            region = 0 if own & set(MAIN_TAGS) else 2 if own & set(SIDE_TAGS) else 1
            self.open.append({"tag": tag, "text": "", "nested": False, "region": region, "chrome": any(t.endswith("!") for t in self.stack)})

    def handle_endtag(self, tag):
        names = [t.rstrip("!") for t in self.stack]
        if tag not in names:
            return
        while self.stack:
            last = self.stack.pop().rstrip("!")
            if last in BLOCK_TAGS and self.open and self.open[-1]["tag"] == last:
                self.out.append(self.open.pop())
            if last == tag:
                break

    def handle_data(self, data):
        names = {t.rstrip("!") for t in self.stack}
        if "title" in names and not self.title:
            self.title = data
        if self.open and not names & set(SKIP_TAGS):
            self.open[-1]["text"] += data

    def close(self):
        super().close()
        while self.open:
            self.out.append(self.open.pop())


def collect(html: str | None, least: int = 2) -> tuple[str, list[dict]]:
    """The document's title and its blocks of ``least`` characters or more that are not only digits and marks."""
    c = _Collector()
    c.feed(html or "")
    c.close()
    out = []
    for b in c.out:
        t = " ".join(b["text"].split())
        if not b["nested"] and not b["chrome"] and len(t) >= least and re.search(r"[^\W\d_]", t):
            out.append({"tag": b["tag"], "region": b["region"], "text": t})
    return " ".join(c.title.split()), out


def html_blocks(pages: DataFrame, least: int = 2, id_col: str = "page_id") -> DataFrame:
    """(id, ord, tag, region, text, title): region 0 main, 1 body, 2 side; in document order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, h in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                title, blocks = collect(h, least)
                rows += [(i, k, b["tag"], b["region"], b["text"], title) for k, b in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=[id_col, "ord", "tag", "region", "text", "title"])

    return pages.select(id_col, "html").mapInPandas(run, f"{id_col} long, ord int, tag string, region int, text string, title string")


def content_order(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    return blocks.orderBy(id_col, "region", "ord")


def primary_title(blocks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The first h1 in the main region, else the first substantial h1 named in the document's title, else the longest h1."""
    h = blocks.where("tag = 'h1'")
    named = (F.length("text") >= 4) & F.lower("title").contains(F.lower("text"))
    rank = F.when(F.col("region") == 0, 0).when(named, 1).otherwise(2)
    place = F.when(rank == 2, -F.length("text")).otherwise(F.col("ord"))
    return h.groupBy(id_col).agg(F.min_by("text", F.struct(rank, place, "ord")).alias("primary"))


def host(c) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(text(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def site_rules(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Each page's first rule (ord, host, ...) whose host it is or lies under; null without.

    The page's host and parent domains are exploded, so the join is an equality.
    """
    r = rules.select(F.regexp_replace(F.trim("host"), r"^www\.", "").alias("__suffix"), F.struct("ord", "host").alias("rule")).where("__suffix <> ''")
    # the row number is made once and carried along: made again for a second branch it could differ
    own = pages.withColumn("__host", host(url)).withColumn("__row", F.monotonically_increasing_id())
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = own.withColumn("__suffix", F.explode(suffixes)).join(r, "__suffix", "left")
    kept = [F.first(c).alias(c) for c in (*pages.columns, "__host")]
    return each.groupBy("__row").agg(*kept, F.min("rule").alias("rule")).drop("__row")


def class_is_chrome(c) -> Column:
    return text(c).rlike(CHROME_CLASSES)


def is_meta_text(c) -> Column:
    t = collapse(c)
    return (t != "") & (F.length(t) < 80) & t.rlike(CHROME_META)


def looks_like_pdf(url) -> Column:
    """A URL of a PDF: by its path's end, by a known repository path, or by a format parameter."""
    t = F.lower(text(url))
    path = F.regexp_replace(t, r"[?#].*$", "")
    return t.rlike("^https?://|^file:") & (path.rlike(r"\.pdf$") | path.rlike(r"arxiv\.org/pdf/") | t.rlike(r"[?&](?:format|type)=pdf\b") | path.rlike(r"/pdf/[^/]+$"))


def limit_blocks(blocks: DataFrame, mode, id_col: str = "page_id") -> DataFrame:
    """``all``, the first n, or ``preview``: one heading (an h1, else any) and one body block that is not it."""
    from pyspark.sql import Window

    if mode == "all":
        return blocks
    w = Window.partitionBy(id_col).orderBy("ord")
    if mode != "preview":
        return blocks.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= int(mode)).drop("__k")
    heading, body = F.col("tag").rlike("^h[1-6]$"), F.col("tag").isin("p", "li", "blockquote", "dd", "td")
    rank = F.when(F.col("tag") == "h1", 0).when(heading, 1)
    best = blocks.withColumn("__h", F.row_number().over(Window.partitionBy(id_col).orderBy(rank.asc_nulls_last(), "ord")))
    best = best.withColumn("__h", (F.col("__h") == 1) & heading)
    rest = F.when(~F.col("__h"), F.when(body, 0).otherwise(1))
    best = best.withColumn("__b", F.row_number().over(Window.partitionBy(id_col).orderBy(rest.asc_nulls_last(), "ord")))
    return best.where("__h or (__b = 1)").drop("__h", "__b")


def pick_preset(url: Column, presets: list[tuple[str, str]]) -> Column:
    """The first preset (name, pattern of hosts) that a URL's host fits; null without."""
    h = host(url)
    return F.coalesce(*(F.when(h.rlike(p), F.lit(n)) for n, p in presets)) if presets else F.lit(None).cast("string")


# --- fixed values: what stays of HTML in notes ----------------------------------------------------
KEPT_TAGS = (
    "a", "blockquote", "br", "code", "del", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "ol", "p", "pre", "strong", "sub", "sup", "table", "tbody",
    "td", "th", "thead", "tr", "ul",
)
SAFE_URL = r"^(?:https?:|mailto:|#|/(?!/))"
# --------------------------------------------------------------------------------------------------


class _Sanitizer(HTMLParser):
    """Kept tags with their safe attributes; all other tags as escaped text."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []

    def safe(self, tag: str, attrs) -> str:
        own = ""
        for name, value in attrs:
            value = (value or "").strip()
            if tag == "a" and name == "href" and re.match(SAFE_URL, value, re.I) and not re.search(r"[\x00-\x20\x7f]", value):
                own += f' href="{escape(value)}"'
            elif tag == "a" and name == "title" and value and not re.search(r"[\x00-\x1f\x7f]", value):
                own += f' title="{escape(value)}"'
            elif tag == "code" and name == "class" and re.fullmatch(r"language-[A-Za-z0-9_+-]+", value):
                own += f' class="{value}"'
            elif tag == "ol" and name == "start" and re.fullmatch(r"\d{1,9}", value):
                own += f' start="{value}"'
        return own

    def handle_starttag(self, tag, attrs):
        self.out.append(f"<{tag}{self.safe(tag, attrs)}>" if tag in KEPT_TAGS else escape(self.get_starttag_text(), quote=False))

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.out.append(f"</{tag}>" if tag in KEPT_TAGS else f"&lt;/{tag}&gt;")

    def handle_data(self, data):
        self.out.append(escape(data, quote=False))

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    def handle_comment(self, data):
        self.out.append(f"&lt;!--{escape(data, quote=False)}--&gt;")

    def handle_decl(self, decl):
        self.out.append(f"&lt;!{escape(decl, quote=False)}&gt;")

    handle_pi = unknown_decl = handle_decl


def sanitized(html: str | None) -> str:
    p = _Sanitizer()
    p.feed(html or "")
    p.close()
    return "".join(p.out)


@F.pandas_udf(T.StringType())
def sanitize_html(s: pd.Series) -> pd.Series:
    """HTML of notes with only kept tags and safe attributes."""
    return s.map(sanitized)
