"""Identifiers that follow from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

SEPARATOR = "\x1f"


def quantize(c: Column) -> Column:
    """To 0.01, ties up; null and non-finite as 0."""
    fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(fine, F.floor(c * 100 + 0.5) / 100).otherwise(0.0)


def number(c: Column) -> Column:
    """A quantized number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), "0+$", ""), r"\.$", "")


def element_fingerprint(kind: Column, char: Column, font: Column, box: list[Column], path_hash: Column) -> Column:
    own = F.concat_ws(",", *(number(quantize(b)) for b in box))
    return F.concat_ws(SEPARATOR, text(kind), text(char), text(font), own, text(path_hash))


def element_id(fingerprint: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("e"), F.substring(F.sha2(F.concat_ws(SEPARATOR, fingerprint, ordinal.cast("string")), 256), 1, 16))


def unit_id(members: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.array_join(F.array_sort(members), ","), 256), 1, 12))


def block_text(c, length: int | None = 200) -> Column:
    """Letters and digits of a block in lower case, placeholders dropped."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text(c), r"⟦f\d+⟧", " ")), r"[^\p{L}\p{N}]+", "")
    return F.substring(t, 1, length) if length else t


def block_seed(kind: Column, c: Column, box: list[Column] | None = None) -> Column:
    """``t|text`` for text blocks with any, else kind and box in two hundredths; empty without both."""
    own = F.when((kind == "t") & (block_text(c) != ""), F.concat(F.lit("t|"), block_text(c)))
    if box is None:
        return F.coalesce(own, F.lit(""))
    grid = F.concat_ws(",", *(F.floor(b * 200 + 0.5).cast("string") for b in box))
    return F.coalesce(own, F.when(box[0].isNotNull(), F.concat(kind, F.lit("|"), grid)), F.lit(""))


def fnv36(c: Column) -> Column:
    """FNV-1a of the code points, 32 bits, in base 36 padded to seven digits."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    mask = F.lit(0xFFFFFFFF)
    step = lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(mask)
    two = lambda h, p: F.when(p > 0xFFFF, step(step(h, p.bitwiseAND(F.lit(0xFFFF))), F.shiftright(p, 16))).otherwise(step(h, p))
    h = F.aggregate(points, F.lit(2166136261).cast("long"), two)
    return F.lpad(F.lower(F.conv(h.cast("string"), 10, 36)), 7, "0")


def reuse_key(c) -> Column:
    """Key of a source text for reuse: SHA-256 of its collapsed form."""
    from .text import collapse

    return F.sha2(collapse(c), 256)


def arxiv_id(c) -> Column:
    """(id, version) from a preprint server's URL or an id, or null; old ids keep their archive."""
    t = F.regexp_replace(F.trim(text(c)), r"(?i)\.pdf$", "")
    t = F.regexp_replace(t, r"(?i)^(?:https?://)?(?:www\.)?arxiv\.org/(?:pdf|abs|src|e-print|html)/|^arxiv:\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"(?i)\.pdf$", "")
    pattern = r"(?i)^(\d{4}\.\d{4,5}|[a-z][a-z-]*(?:\.[a-z]{2})?/\d{7})(v\d+)?$"
    own = F.regexp_extract(t, pattern, 1)
    version = F.lower(F.regexp_extract(t, pattern, 2))
    return F.when(own != "", F.struct(own.alias("id"), F.nullif(version, F.lit("")).alias("version")))
