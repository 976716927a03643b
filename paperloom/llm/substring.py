"""Deduplication of lines and passages across a corpus: the earliest occurrence stays, the rest go with their offsets kept.

Lines are cut further after words chosen by their content, so that a passage copied into the middle of other
lines is made of the same units. Digests are taken over runs of adjacent units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize

#: Words of a run of units that is digested, at least. Units cut off up to some words at each end of a copied passage, so
#: passages of over fifty words have such a run. Whole runs of any smaller number can be asked for.
LEAST_WORDS = 35
#: A unit ends at a line's end, and after a word whose digest has this remainder zero.
CUT = 12
#: The memory of words is emptied beyond so many; it only saves time.
WORDS_KEPT = 400_000
#: Every character of the scripts written without spaces is a word; other words end at white space.
_WORD = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]|[^ \t-\r\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]+")


class _Ends(dict):
    """Whether a word, as it stands in a text, ends a unit, and its normal form."""

    def __missing__(self, word: str) -> tuple[bytes, bool]:
        if len(self) > WORDS_KEPT:
            self.clear()
        own = word.lower().encode("utf-8", "replace")
        self[word] = out = own, int(hashlib.md5(own).hexdigest()[:4], 16) % CUT == 0
        return out


_ends = _Ends()


def units(text: str) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Normal form, start, end and number of words of each unit; code points, end exclusive."""
    form, start, end, size = [], [], [], []
    at = 0
    for line in text.split("\n"):
        own: list[bytes] = []
        first = last = 0
        for m in _WORD.finditer(line):
            norm, ends = _ends[m[0]]
            if not own:
                first = m.start()
            own.append(norm)
            if ends:
                form.append(b" ".join(own)), start.append(at + first), end.append(at + m.end()), size.append(len(own))
                own = []
            else:
                last = m.end()
        if own:
            form.append(b" ".join(own)), start.append(at + first), end.append(at + last), size.append(len(own))
        at += len(line) + 1
    return form, start, end, size


def runs(text: str, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(unit, last unit, start, end, words before, words up to its end, digest) of the shortest run of at least
    ``least_words`` words from each unit on."""
    form, start, end, size = units(text)
    k, before, after = 0, 0, 0
    for i in range(len(form)):
        while k < len(form) and (after - before < least_words or k <= i):
            after += size[k]
            k += 1
        if after - before < least_words:
            return
        yield i, k - 1, start[i], end[k - 1], before, after, hashlib.md5(b" ".join(form[i:k])).digest()
        before += size[i]


_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
_NAMES = ["doc_id", "row", "unit", "last", "start", "end", "before", "after", "digest"]


def _digests(docs: DataFrame, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each digested run; ``row`` stands for the text, so that rows of one id and other texts stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, r, *u) for d, t, r in zip(*(b.column(i).to_pylist() for i in range(3))) for u in runs(t, least_words)]
            cols = zip(*rows) if rows else ((),) * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)

    own = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, row long, unit int, last int, start int, end int, before int, after int, digest binary")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place of every passage that stands more than once: doc_id, row, start, end, words, kept, copies, kept_doc_id.

    Two places hold the same passage if a run of adjacent units of at least ``least_words`` words is equal in lower case
    with single spaces. The place of the smallest (doc_id, unit) is ``kept``, the others go; a null doc_id ranks first. Runs
    that touch or overlap are one passage; ``copies`` is the greatest number of places of its runs, ``kept_doc_id`` the
    document that keeps its first run. A kept passage may overlap a removed one, where removal wins.

    Null, empty or shorter texts give nothing. Rows that repeat a doc_id with the same text are the same place, so neither
    goes for the other; with other texts they are places of their own (``row`` tells them apart). An empty table gives no
    rows; other columns are not read.

    Digests, not texts, are shuffled. The earliest place is a minimum, combined before the shuffle; only digests that do
    repeat are joined back, and a passage that stands in very many documents is a skewed key that adaptive execution
    splits.
    """
    own = materialize(_digests(docs, least_words, id_col, text_col), "runs")
    place = F.struct("doc_id", "row", "unit")
    first = own.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("final"), F.count("*").alias("copies"))
    first = first.where("copies > 1 and not (first <=> final)").select("digest", "first", "copies")
    first = materialize(first, "first")  # written, so that the join deals its keys anew and can split them
    placed = own.join(first, "digest").withColumn("kept", F.struct("doc_id", "row", "unit").eqNullSafe(F.col("first")))
    of = ["doc_id", "row", "kept"]
    order = Window.partitionBy(*of).orderBy("unit", "last")
    so_far = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = placed.withColumn("new", F.coalesce(F.col("unit") > so_far + 1, F.lit(True)).cast("int"))
    numbered = begins.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*of, "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("after") - F.min("before")).alias("words"),
        F.max("copies").alias("copies"), F.min_by(F.col("first.doc_id"), F.col("unit")).alias("kept_doc_id"),
    ).select("doc_id", "row", "start", "end", "words", "kept", "copies", "kept_doc_id")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text without its repeated passages, and ``removed``: their spans in the original text; a row for each input row.

    White space after a removed passage goes with it up to the next line end. Null text is empty; text without repeats stays as it is with null
    ``removed``; repeated rows come out alike; an empty table gives no rows.
    """
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    found = passages(docs, least_words, id_col, text_col).where("not kept")
    found = found.groupBy(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).agg(spans.alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, at = [], 0
                for s in cut or []:
                    kept.append(text[at : s["start"]])
                    at = s["end"]
                    while at < len(text) and text[at] in " \t\r":
                        at += 1
                    if text[at : at + 1] == "\n" and (not s["start"] or text[s["start"] - 1] == "\n"):
                        at += 1  # the whole line goes
                out.append("".join([*kept, text[at:]]) if cut else text)
            yield b.set_column(1, "text", pa.array(out, pa.string()))

    own = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))
    joined = own.join(found, same, "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(run, joined.schema)


ORACLE = rf"""
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS k FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''),
      '[\x{{2e80}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]|\n|[ \t\x0b-\r]+|[^ \t-\r\x{{2e80}}-\x{{9fff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]+') AS p
    FROM documents)
), placed AS (
  SELECT doc_id, k, piece, sum(length(piece)) OVER w - length(piece) AS start, sum(length(piece)) OVER w AS stop,
         sum((piece = chr(10))::INT) OVER w AS line
  FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), words AS (
  SELECT doc_id, k, lower(piece) AS word, start, stop, line, row_number() OVER w AS pos,
         (coalesce(lag(line) OVER w <> line, true)
          OR ('0x' || substr(md5(lag(lower(piece)) OVER w), 1, 4))::INT % {CUT} = 0)::INT AS begins
  FROM placed WHERE NOT regexp_matches(piece, '^[ \t-\r]+$') WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS unit FROM words
), units AS (
  SELECT doc_id, unit, min(start) AS start, max(stop) AS stop, min(pos) - 1 AS before, max(pos) AS after FROM numbered GROUP BY ALL
), texts AS (
  SELECT doc_id, list(word ORDER BY k) AS w FROM words GROUP BY doc_id
), runs AS (
  SELECT a.doc_id, a.unit, b.unit AS last, a.start, b.stop, a.before, b.after,
         array_to_string(t.w[a.before + 1 : b.after], ' ') AS own
  FROM units a ASOF JOIN units b ON a.doc_id = b.doc_id AND a.before + {LEAST_WORDS} <= b.after JOIN texts t ON t.doc_id = a.doc_id
), ranked AS (
  SELECT *, first_value(doc_id) OVER g AS kept_doc_id, row_number() OVER g = 1 AS kept, count(*) OVER (PARTITION BY own) AS copies
  FROM runs WINDOW g AS (PARTITION BY own ORDER BY doc_id, unit)
), begun AS (
  SELECT *, coalesce(unit > max(last) OVER (PARTITION BY doc_id, kept ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true)::INT AS new
  FROM ranked WHERE copies > 1
), passages AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, kept ORDER BY unit) AS passage FROM begun
)
SELECT doc_id, min(start)::INTEGER AS start, max(stop)::INTEGER AS "end", (max(after) - min(before))::INTEGER AS words, kept,
       max(copies) AS copies, arg_min(kept_doc_id, unit) AS kept_doc_id
FROM passages GROUP BY doc_id, kept, passage
"""
