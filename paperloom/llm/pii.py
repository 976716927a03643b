"""Personal data: patterns propose spans, checks confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, lean, slices

#: In the order in which spans are listed; the first four are always kept once confirmed.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
#: Score of a confirmed span, what a context word near it adds, and the least score of the others to be kept.
CONFIRMED, CONTEXT, LEAST = 0.7, 0.3, 0.5
#: Code points before a span in which context words count.
NEAR = 48
CONTEXT_WORDS = {
    "email": re.compile(r"(?i)mail|contact|write"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address"),
    "card": re.compile(r"(?i)card|visa|credit|payment|amex"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax"),
    "iban": re.compile(r"(?i)iban|account|bank"),
    "secret": re.compile(r"(?i)token|secret|key|passw"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, and never gives a digit back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# fixed values: the lengths of IBANs by country, from the public register of ISO 13616
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|passw(?:or)?d|key)\b[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_=-]{16,})")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    own = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places of as many capitals and digits as the country has, with single spaces between, that no further one joins."""
    for m in _IBAN.finditer(text):
        left, at = _IBAN_LENGTHS.get(m[1], 0) - 4, m.end()
        while left > 0 and at < len(text):
            at += text[at] == " "
            if not (at < len(text) and text[at] in _IBAN_CHARACTERS):
                break
            at, left = at + 1, left - 1
        if left == 0 and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(text[m.start() : at]):
            yield m.start(), at


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed in ``KINDS``, then start; code points, end exclusive.

    Each pattern looks for leftmost matches that do not overlap; one that fails its check is
    dropped. Kinds may overlap one another. Every search is linear in the text.
    """
    found: list[tuple[str, int, int, float]] = []

    def add(kind: str, start: int, end: int, score: float = CONFIRMED) -> None:
        near = CONTEXT_WORDS[kind].search(text, max(0, start - NEAR), start)
        score += CONTEXT if near else 0
        if kind in BASE or score >= LEAST:
            found.append((kind, start, end, round(score, 2)))

    for a, b in emails(text):
        add("email", a, b)
    for m in _IP.finditer(text):
        if all(map(_part, m[0].split("."))):
            add("ip", m.start(), m.end())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            add("card", m.start(), m.end())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", m.start(), m.end())
    for start, end in ibans(text):
        add("iban", start, end)
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            own = m[1]
            varied = any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and len(set(own)) >= 8
            add("secret", m.start(1), m.end(1), 0.4 if varied else 0.1)
    return found


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, one row for each input row; null or empty text has none, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score")
        for b in batches:
            found = [[dict(zip(names, s)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), f"doc_id long, spans {SPANS}")


def listed(spans_col: str, base_only: bool = False):
    """kind:start:end of the spans, comma-joined."""
    own = F.col(spans_col)
    if base_only:
        own = F.filter(own, lambda s: s["kind"].isin(*BASE))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(text: str) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first and longest wins."""
    out, at = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]]) if out else text


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its spans masked in the text and the length column brought up to date; all other columns as they are.

    Null text stays null, empty text empty. Every row is masked by itself, so repeated rows come out alike; of spans that begin
    at one place the longest names the kind. An empty table gives none.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k = b.schema.get_field_index(text_col)
            own = [None if t is None else mask(t) for t in b.column(k).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(own, b.schema.field(k).type))

    out = docs.mapInArrow(lean(run), docs.schema)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out
