"""Readers: text, HTML, LaTeX archives, label pages, layouts; files that fail become rows with a status."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_NAMES = r"(?i)\.(?:txt|md|markdown|html?)$"
ARCHIVE_FILES, ARCHIVE_BYTES = 2000, 200 * 1024 * 1024
LABEL_PAGE = (
    "schema string, paperId string, page int, pageWidth double, pageHeight double, source string, "
    "elements array<struct<id:string,kind:string,char:string,font:string,bbox:array<double>,pathHash:string,ordinal:int,label:string,confidence:double,unitId:string,equationNumber:boolean>>, "
    "units array<struct<id:string,type:string,equationNumber:boolean,elementIds:array<string>,confidence:double,fallback:boolean>>, _corrupt string"
)


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def is_plain_text(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(TEXT_NAMES)


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the plain-text files below a folder."""
    return binary(spark, path).where(is_plain_text(F.col("path"))).select("path", F.decode("content", "UTF-8").alias("text"))


def payload_kind(content: Column, content_type: Column | None = None) -> Column:
    """``pdf``, ``challenge`` (a page that asks for a browser) or ``not-pdf`` from the first 1200 bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 1200), "ISO-8859-1"))
    challenge = head.rlike("just a moment|cf-challenge|captcha|enable javascript|access denied|are you a robot")
    return F.when(head.startswith("%pdf-"), "pdf").when(challenge, "challenge").otherwise("not-pdf")


def verified_ingest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (id, sha256) with the status of their file (id, content): ok, missing, challenge, not-pdf, mismatch."""
    own = files.select("id", payload_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("got"), F.length("content").alias("bytes"))
    j = manifest.join(own, "id", "left")
    status = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "pdf", F.col("kind")).when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("got")), "mismatch").otherwise("ok")
    return j.withColumn("status", status).drop("kind")


def sniff(head: bytes) -> str:
    return "pdf" if head[:5] == b"%PDF-" else "gzip" if head[:2] == b"\x1f\x8b" else "tar" if head[257:262] == b"ustar" else "text"


def unpack(content: bytes) -> list[tuple[str, bytes, str]]:
    """(path, bytes, problem) of a LaTeX source: a PDF, one file, or a tar with safe paths under caps on files and bytes."""
    kind = sniff(content)
    if kind == "gzip":
        try:
            with gzip.open(io.BytesIO(content)) as f:
                content = f.read(ARCHIVE_BYTES + 1)
        except (OSError, EOFError) as e:
            return [("", b"", f"gzip: {e}")]
        if len(content) > ARCHIVE_BYTES:
            return [("", b"", "too large")]
        kind = sniff(content)
    if kind == "pdf":
        return [("", b"", "pdf")]
    if kind == "text":
        return [("main.tex", content, "")]
    out, size = [], 0
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                name = posixpath.normpath(m.name)
                if not m.isfile() or name.startswith(("/", "..")) or "\0" in name:
                    out.append((m.name, b"", "" if m.isdir() else "unsafe"))
                    continue
                size += m.size
                if len(out) >= ARCHIVE_FILES or size > ARCHIVE_BYTES:
                    out.append((name, b"", "over the cap"))
                    break
                out.append((name, tar.extractfile(m).read(), ""))
    except tarfile.TarError as e:
        out.append(("", b"", f"tar: {e}"))
    return [o for o in out if o[1] or o[2]]


def archives(files: DataFrame) -> DataFrame:
    """(id, path, content, problem) of every file in the archives (id, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, c in zip(pdf.id, pdf.content) for r in unpack(bytes(c))]
            yield pd.DataFrame(rows, columns=["id", "path", "content", "problem"])

    return files.select("id", "content").mapInPandas(run, "id string, path string, content binary, problem string")


def label_pages(spark: SparkSession, path: str) -> DataFrame:
    """Label pages, one JSON file each; unreadable ones keep their text in ``_corrupt``."""
    return spark.read.schema(LABEL_PAGE).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(path)


def units_of(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Units of label pages with the fields of their document; pages of other documents are left out."""
    u = pages.select("paperId", "page", F.explode("units").alias("u")).select("paperId", "page", F.col("u.id").alias("unitId"), "u.type", F.coalesce("u.equationNumber", F.lit(False)).alias("equationNumber"), "u.elementIds", "u.confidence", "u.fallback")
    return u.join(manifest.select(F.col("id").alias("paperId"), "field", "sourceType"), "paperId")


FOLDERS = {"library.json": "library", "paper.json": "paper"}


def classify_folders(files: DataFrame) -> DataFrame:
    """Folders of a path listing as library, parent, partial, unrelated or empty, by the names of their files."""
    own = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    g = own.groupBy("dir").agg(
        F.count_if(F.col("name") == "paper.json").alias("papers"), F.count_if(F.col("name").rlike(r"^page-\d+\.json$")).alias("pages"),
        F.count_if(F.col("name") == "library.json").alias("libraries"), F.count_if(F.col("length") > 0).alias("files"),
    )
    kind = F.when(F.col("papers") > 0, F.when(F.col("pages") > 0, "library").otherwise("partial")).when(F.col("libraries") > 0, "parent").when(F.col("pages") > 0, "partial").when(F.col("files") == 0, "empty").otherwise("unrelated")
    return g.select("dir", kind.alias("kind"), "papers", "pages")


def legacy_pages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of legacy JSON texts (docHash, json), and the texts that cannot be read."""
    schema = "page int, runState string, pairs array<struct<bid:string,text:string,translation:string>>, layout string, _corrupt string"
    own = raw.withColumn("r", F.from_json("json", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("r._corrupt").isNull() & (F.col("r.page") >= 1)
    return own.where(good).select("docHash", "r.page", "r.runState", "r.pairs", "r.layout"), own.where(~F.coalesce(good, F.lit(False))).select("docHash", "json")


VENDOR_LABELS = {
    "doc_title": "title", "paragraph_title": "heading", "text": "text", "abstract": "text", "content": "text", "figure_title": "caption", "table_title": "caption",
    "image": "figure", "figure": "figure", "chart": "figure", "table": "table", "formula": "formula", "display_formula": "formula", "header": "header", "footer": "footer",
    "number": "footer", "footnote": "aside", "aside_text": "aside", "reference": "text",
}
ENVELOPE = "vendor string, page int, pixelWidth double, pixelHeight double, layoutDetails array<struct<label:string,bbox_2d:array<double>,content:string>>"


def vendor_blocks(envelopes: DataFrame) -> DataFrame:
    """Blocks (doc, page, id, ord, label, box, text) of vendor envelopes (doc, json): boxes normalised to the page, labels mapped, captions given their figure."""
    from ..operators.match import prior_figure

    e = envelopes.withColumn("e", F.from_json("json", ENVELOPE)).select("doc", "e.*", F.posexplode("e.layoutDetails").alias("ord", "b"))
    table = F.create_map(*(x for k, v in VENDOR_LABELS.items() for x in (F.lit(k), F.lit(v))))
    b = F.col("b.bbox_2d")
    box = F.struct((b[0] / F.col("pixelWidth")).alias("x0"), (b[1] / F.col("pixelHeight")).alias("y0"), (b[2] / F.col("pixelWidth")).alias("x1"), (b[3] / F.col("pixelHeight")).alias("y1"))
    rows = e.where(F.size("b.bbox_2d") == 4).select("doc", "page", F.concat(F.lit("v"), F.col("ord").cast("string")).alias("id"), "ord", F.coalesce(table[F.lower("b.label")], F.lit("text")).alias("label"), box.alias("box"), F.col("b.content").alias("text"))
    return prior_figure(rows.withColumn("doc_page", F.struct("doc", "page")), "doc_page").drop("doc_page")


MODEL_PAGE = "columns int, blocks array<struct<id:string,label:string,order:int,bbox:array<double>,text:string,latex:string,conf:double,continues:boolean>>"


def model_blocks(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of a model's page JSON (doc, page, json), renumbered from 1, and the pages refused: no JSON or a repeated order."""
    bare = F.regexp_replace(F.trim("json"), r"(?s)^```[a-z]*\s*|\s*```$", "")
    own = pages.withColumn("m", F.from_json(bare, MODEL_PAGE))
    orders = F.transform("m.blocks", lambda b: b["order"])
    bad = F.col("m.blocks").isNull() | (F.size(F.array_distinct(orders)) < F.size(orders))
    ranked = own.where(~bad).select("doc", "page", F.posexplode(F.array_sort(F.transform("m.blocks", lambda b: F.struct(b["order"].alias("order"), b.alias("b"))))).alias("k", "r"))
    return ranked.select("doc", "page", (F.col("k") + 1).alias("ord"), "r.b.*").drop("order"), own.where(bad).select("doc", "page", "json")


# --- LaTeX ----------------------------------------------------------------------------------------

_BEGIN = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}|\\(section|subsection|subsubsection|caption|label|tag)\*?\s*\{|\\\\|\\(?:nonumber|notag)")


def _braced(s: str, at: int) -> tuple[str, int]:
    depth, k = 1, at
    while k < len(s) and depth:
        depth += {"{": 1, "}": -1}.get(s[k], 0) if s[k - 1 : k] != "\\" else 0
        k += 1
    return s[at : k - 1], k


def expand_macros(s: str, rounds: int = 4) -> str:
    """Simple ``\\newcommand`` and ``\\def`` macros replaced, with up to nine arguments."""
    macros = {}
    for m in re.finditer(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?(?:\[(\d)\])?\s*\{", s):
        macros[m[1]] = (int(m[2] or 0), _braced(s, m.end())[0])
    for m in re.finditer(r"\\def\s*\\([A-Za-z]+)\s*\{", s):
        macros.setdefault(m[1], (0, _braced(s, m.end())[0]))
    s = re.sub(r"\\(?:re)?newcommand\*?\s*\{?\\[A-Za-z]+\}?(?:\[\d\])?\s*(?=\{)", r"\\newcommanddone", s)
    out = s
    for _ in range(rounds):
        done, k, hit = [], 0, False
        for m in re.finditer(r"\\([A-Za-z]+)", out):
            if m.start() < k or m[1] not in macros:
                continue
            n, body = macros[m[1]]
            end, args = m.end(), []
            for _i in range(n):
                while end < len(out) and out[end].isspace():
                    end += 1
                if end >= len(out) or out[end] != "{":
                    break
                a, end = _braced(out, end + 1)
                args.append(a)
            if len(args) < n:
                continue
            for i, a in enumerate(args, 1):
                body = body.replace(f"#{i}", a)
            done += [out[k : m.start()], body]
            k, hit = end, True
        out = "".join([*done, out[k:]])
        if not hit or len(out) > 20 * len(s) + 100_000:
            break
    return out


def latex_units(files: dict[str, str]) -> list[dict]:
    """Paragraphs, headings, displays and captions of a LaTeX source in order, with counters for sections, equations, figures and tables.

    The main file is the one with a document class; includes are read in. Each row of a display of several lines takes a number unless it says otherwise.
    """
    main = next((p for p, t in sorted(files.items()) if r"\documentclass" in t), min(files, default=None))
    if main is None:
        return []

    def read(path: str, seen: frozenset) -> str:
        s = re.sub(r"(?<!\\)%.*", "", files.get(path) or files.get(path + ".tex") or "")
        get = lambda m: "" if m[1] in seen or len(seen) > 30 else read(m[1].strip(), seen | {m[1]})
        return re.sub(r"\\(?:input|include)\s*\{([^{}]+)\}", get, s)

    s = expand_macros(read(main, frozenset({main})))
    if r"\begin{document}" in s:
        s = s.split(r"\begin{document}", 1)[1].split(r"\end{document}", 1)[0]
    counts = {"section": 0, "subsection": 0, "subsubsection": 0, "equation": 0, "figure": 0, "table": 0}
    out: list[dict] = []

    def add(kind, text, number=None, latex=None):
        text = " ".join(text.split())
        if text or latex:
            out.append({"id": f"s{len(out)}", "kind": kind, "text": text, "latex": latex, "number": number})

    def prose(part: str) -> None:
        for p in re.split(r"\n\s*\n", part):
            add("text", re.sub(r"[{}~]", " ", re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ", p)))

    at = 0
    while m := _BEGIN.search(s, at):
        if m[1] == "begin" and m[2].rstrip("*") in ("equation", "align", "gather", "multline", "eqnarray", "figure", "table"):
            prose(s[at : m.start()])
            close = s.find(rf"\end{{{m[2]}}}", m.end())
            close = len(s) if close < 0 else close
            body, env = s[m.end() : close], m[2].rstrip("*")
            if env in ("figure", "table"):
                counts[env] += 1
                if c := re.search(r"\\caption(?:\[[^\]]*\])?\s*\{", body):
                    add("caption", re.sub(r"\\[A-Za-z]+\*?|[{}]", " ", _braced(body, c.end())[0]), f"{env} {counts[env]}")
            else:
                rows = re.split(r"\\\\", body) if env in ("align", "gather", "eqnarray") else [body]
                for row in rows:
                    tag = re.search(r"\\tag\{([^{}]*)\}", row)
                    number = tag[1] if tag else None
                    if not tag and not m[2].endswith("*") and row.strip() and not re.search(r"\\(?:nonumber|notag)", row):
                        counts["equation"] += 1
                        number = str(counts["equation"])
                    add("display", "", number, " ".join(re.sub(r"\\(?:label|tag)\{[^{}]*\}|\\(?:nonumber|notag)", "", row).split()))
            at = close + len(rf"\end{{{m[2]}}}")
        elif m[3] in ("section", "subsection", "subsubsection"):
            prose(s[at : m.start()])
            title, at = _braced(s, m.end())
            levels = ["section", "subsection", "subsubsection"]
            counts[m[3]] += 1
            for lower in levels[levels.index(m[3]) + 1 :]:
                counts[lower] = 0
            add("heading", title, ".".join(str(counts[l]) for l in levels[: levels.index(m[3]) + 1]))
        else:
            prose(s[at : m.start()])
            at = _braced(s, m.end())[1] if m[3] else m.end()
    prose(s[at:])
    return out


def parse_latex(sources: DataFrame) -> DataFrame:
    """Units (paper, id, ord, kind, text, latex, number) of LaTeX sources (paper, path, text); a paper is one group."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = latex_units(dict(zip(pdf.path, pdf.text)))
        return pd.DataFrame([(key[0], r["id"], k, r["kind"], r["text"], r["latex"], r["number"]) for k, r in enumerate(rows)], columns=["paper", "id", "ord", "kind", "text", "latex", "number"])

    return sources.groupBy("paper").applyInPandas(run, "paper string, id string, ord int, kind string, text string, latex string, number string")


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
