"""Sinks: Markdown, plain text, HTML and diagnostic packages as columns or files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, escape_html, text
from ..operators import events


def article_markdown(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """One Markdown text a document: headings by level, lists and quotes by tag, others as paragraphs."""
    t, tag = collapse("text"), text("tag")
    mark = F.when(tag.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "))).when(tag == "li", "- ").when(tag == "blockquote", "> ").otherwise("")
    own = blocks.where(t != "").select(key, "ord", F.concat(mark, t).alias("line"))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))


def study_text(items: DataFrame) -> DataFrame:
    """Study items as text blocks and Markdown list entries."""
    plain = F.concat_ws("\n", collapse("original"), collapse("translation"), F.nullif(collapse("context"), F.lit("")))
    md = F.concat(F.lit("- **"), collapse("original"), F.lit("** — "), collapse("translation"))
    return items.select("id", plain.alias("txt"), md.alias("markdown"))


def bilingual_html(pairs: DataFrame, key: str = "doc") -> DataFrame:
    """One HTML text a document: every pair escaped, in order."""
    part = F.concat(F.lit("<p>"), escape_html("text"), F.lit("</p><p>"), escape_html("translation"), F.lit("</p>"))
    own = pairs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x["part"]), "\n").alias("html"))
    return own.withColumn("html", F.concat(F.lit("<!doctype html><meta charset=utf-8>\n"), F.col("html")))


def diagnostic_package(log: DataFrame, path: str, secrets: list[str] = ()) -> None:
    """Cleaned events as JSON lines."""
    events.clean(log, secrets).write.mode("overwrite").json(path)
