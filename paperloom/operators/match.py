"""Matching between texts, boxes and sets: joins where a set will do, grouped pandas where order decides."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..functions.distance import Patterns
from ..functions.text import collapse, flow_text, nfkc, sentences, text

ANCHOR_WORDS = 4
#: Beyond so many cells an alignment between anchors goes forward greedily.
CELLS = 250_000
#: Pairs of a page's blocks whose bounds are held at once.
_CELLS_AT_ONCE = 1 << 19
WORD_RATE, BLOCK_RATE, FLOAT_DICE = 0.85, 0.9, 0.6
STOP_WORDS = ("the", "and", "for", "that", "with", "this", "from", "are", "was", "were", "which", "have", "has", "not", "but", "can", "our", "its", "their", "these")
SENTENCE_DISTANCE, ALIGN_CUT, PARAGRAPH_OVERLAP = 0.3, 0.45, 0.5


# --- words and n-grams ----------------------------------------------------------------------------


def fold_words(s: str) -> list[tuple[str, int, int]]:
    """(word, start, end): accents folded to a-z0-9, placeholders and citations skipped, hyphens at line ends joined."""
    masked = re.sub(r"⟦f\d+⟧|\[\d+(?:\s*[,–-]\s*\d+)*\]", lambda m: " " * len(m[0]), s or "")
    out, at, word = [], 0, ""
    for k, ch in enumerate(masked + " "):
        base = "".join(c for c in unicodedata.normalize("NFKD", ch).lower() if c.isascii() and c.isalnum())
        if base:
            at = k if not word else at
            word += base
        elif word and ch in "-­‐" and re.match(r"\s*\n\s*[a-z]", masked[k + 1 : k + 8]):
            continue
        elif word and not (ch.isspace() and re.search(r"[-­‐]\s*$", masked[at:k]) and "\n" in masked[at : k + 1]):
            out.append((word, at, k))
            word = ""
    return out


_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_WORDS)
def words_with_offsets(s):
    return s.map(lambda x: [{"word": w, "start": a, "end": b} for w, a, b in fold_words(x)])


def ascii_words(c) -> Column:
    """Runs of a-z0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), 0)


def ngrams(c: Column, n: int = ANCHOR_WORDS) -> Column:
    """(position, n-gram) of an array of words."""
    k = F.size(c) - n + 1
    each = F.transform(F.sequence(F.lit(1), k), lambda i: F.struct((i - 1).alias("pos"), F.array_join(F.slice(c, i, n), " ").alias("gram")))
    return F.when(k > 0, each).otherwise(F.array().cast("array<struct<pos:int,gram:string>>"))


def unique_anchors(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n: int = ANCHOR_WORDS) -> DataFrame:
    """n-grams that stand once in a text of each side: (left_id, right_id, left_pos, right_pos); inputs have an id and words.

    Give the smaller side as ``right``: n-grams of the left that it lacks go before any are counted.
    """

    def once(df, key, name, only=None):
        g = df.select(F.col(key), F.explode(ngrams(F.col("words"), n)).alias("g")).select(key, "g.*")
        g = g if only is None else g.join(only, "gram", "left_semi")
        return g.groupBy(key, "gram").agg(F.count("*").alias("c"), F.min("pos").alias(name)).where("c = 1").drop("c")

    r = once(right, right_id, "right_pos")
    return once(left, left_id, "left_pos", r.select("gram")).join(r, "gram").select(left_id, right_id, "left_pos", "right_pos")


def monotone(anchors: list[tuple[int, int]], n: int = ANCHOR_WORDS) -> list[tuple[int, int]]:
    """By left position, those at least ``n`` words beyond the last kept on both sides; the start counts as one kept just before it."""
    out, left, right = [], -1, -1
    for a, b in sorted(anchors):
        if a >= left + n and b >= right + n:
            out.append((a, b))
            left, right = a, b
    return out


def lcs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence; of ties the left side moves back first. Over ``CELLS`` greedily forward."""
    if len(a) * len(b) > CELLS:
        out, at = [], 0
        for i, w in enumerate(a):
            try:
                at = b.index(w, at)
            except ValueError:
                continue
            out.append((i, at))
            at += 1
        return out
    rows = [[0] * (len(b) + 1)]
    for w in a:
        prev, row = rows[-1], [0]
        for j, v in enumerate(b):
            row.append(prev[j] + 1 if w == v else max(prev[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align_words(a: list[str], b: list[str], n: int = ANCHOR_WORDS) -> list[tuple[int, int]]:
    """Matched positions: unique n-grams as anchors, a subsequence in each gap between them."""

    def once(w):
        g = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {tuple(w[k : k + n]): k for k in range(len(w) - n + 1) if g[tuple(w[k : k + n])] == 1}

    ga, gb = once(a), once(b)
    out: list[tuple[int, int]] = []
    i = j = 0
    for x, y in [*monotone([(ga[g], gb[g]) for g in ga.keys() & gb.keys()], n), (len(a), len(b))]:
        if x < i or y < j:
            continue
        out += [(i + p, j + q) for p, q in lcs(a[i:x], b[j:y])]
        k = 0
        while k < n and x + k < len(a) and y + k < len(b):
            out.append((x + k, y + k))
            k += 1
        i, j = x + k, y + k
    return out


def align_documents(source: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: words of its source (doc, ord, text) aligned to those of its blocks (doc, ord, text).

    doc, words, matched, rate, good_blocks, blocks, use_source (rate of 0.85 or more). One document is one task's group.
    """
    both = source.select("doc", F.lit(0).alias("side"), "ord", "text").unionByName(blocks.select("doc", F.lit(1).alias("side"), "ord", "text"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord"])
        a = [w for t in pdf[pdf.side == 0].text for w, *_ in fold_words(t)]
        owners, b = [], []
        for o, t in zip(pdf[pdf.side == 1].ord, pdf[pdf.side == 1].text):
            own = [w for w, *_ in fold_words(t)]
            b += own
            owners += [o] * len(own)
        hit = {j for _, j in align_words(a, b)}
        each, got = Counter(owners), Counter(owners[j] for j in hit)
        good = sum(got[o] / each[o] >= BLOCK_RATE for o in each)
        rate = len(hit) / len(b) if b else 0.0
        return pd.DataFrame([(key[0], len(b), len(hit), rate, good, len(each), rate >= WORD_RATE)], columns=["doc", "words", "matched", "rate", "good_blocks", "blocks", "use_source"])

    return both.groupBy("doc").applyInPandas(run, "doc long, words long, matched long, rate double, good_blocks long, blocks long, use_source boolean")


# --- similarities ---------------------------------------------------------------------------------


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, F.size(F.array_intersect(a, b)) / whole).otherwise(both_empty)


def chars_of(c) -> Column:
    """Distinct characters but white space."""
    return F.array_distinct(F.filter(F.split(text(c), ""), lambda x: ~x.rlike(r"^\s*$")))


def charset_jaccard(a: Column, b: Column) -> Column:
    """Over distinct characters but white space; 0 where a side is empty. Passes at 0.9."""
    x, y = chars_of(a), chars_of(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def dice_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str | None = None) -> DataFrame:
    """Dice over bags of words of pairs that share one: 2 x common / all. Inputs have an id and words (and a key to match within)."""
    extra = [key] if key else []
    bag = lambda df, i, n: df.select(*extra, F.col(i), F.explode("words").alias("w")).groupBy(*extra, i, "w").agg(F.count("*").alias(n))
    size = lambda df, i, n: df.select(*extra, F.col(i), F.size("words").alias(n))
    common = bag(left, left_id, "a").join(bag(right, right_id, "b"), [*extra, "w"]).groupBy(*extra, left_id, right_id).agg(F.sum(F.least("a", "b")).alias("common"))
    own = common.join(size(left, left_id, "na"), [*extra, left_id]).join(size(right, right_id, "nb"), [*extra, right_id])
    return own.withColumn("dice", 2 * F.col("common") / (F.col("na") + F.col("nb")))


def same_set(a: Column, b: Column) -> Column:
    """Both arrays hold the same values, however often and in whatever order."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def flow_tokens(c) -> Column:
    return F.filter(F.split(flow_text(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def overlap_share(left: Column, right: Column) -> Column:
    """Share of the left tokens that the right side holds."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.filter(left, lambda w: F.array_contains(right, w))) / F.size(left))


def sentence_distance(a: Column, b: Column) -> Column:
    """Levenshtein of the first 400 characters over the full greater length, so long texts look closer; 1 against empty text."""
    x, y = F.lower(collapse(a)), F.lower(collapse(b))
    far = F.levenshtein(F.substring(x, 1, 400), F.substring(y, 1, 400)) / F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 0.0).when((x == "") | (y == ""), 1.0).otherwise(far)


def find_quote(c, quote: Column, prefix: Column, suffix: Column) -> Column:
    """0-based place of a quote in its context, else of the quote; null where it is not."""
    t, q, p = text(c), text(quote), text(prefix)
    near = F.position(F.concat(p, q, text(suffix)), t)
    alone = F.position(q, t)
    return F.when(q == "", F.lit(None)).when(near > 0, near - 1 + F.length(p)).when(alone > 0, alone - 1)


# --- greedy and monotone --------------------------------------------------------------------------


def greedy_pairs(pairs: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Best score first, then the left index; each side used once."""
    left, right, out = set(), set(), []
    for s, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in left and j not in right:
            left.add(i), right.add(j)
            out.append((s, i, j))
    return out


def unit_accuracy(truth: DataFrame, predicted: DataFrame, key: str = "doc") -> DataFrame:
    """Per key: exact units, units, accuracy and mean Jaccard of a greedy one-to-one match of element sets; 1 where there are no units.

    Scores are made by a join on elements; only scored pairs reach the greedy step.
    """
    t = truth.select(key, F.col("id").alias("tid"), F.array_distinct("elementIds").alias("te"))
    p = predicted.select(key, F.col("id").alias("pid"), F.array_distinct("elementIds").alias("pe"))
    hits = t.select(key, "tid", F.size("te").alias("nt"), F.explode("te").alias("e")).join(
        p.select(key, "pid", F.size("pe").alias("np"), F.explode("pe").alias("e")), [key, "e"]
    )
    scored = hits.groupBy(key, "tid", "pid", "nt", "np").agg(F.count("*").alias("c")).withColumn("s", F.col("c") / (F.col("nt") + F.col("np") - F.col("c")))
    total = t.groupBy(key).agg(F.count("*").alias("total"))

    def run(batches):
        for pdf in batches:
            got = [greedy_pairs([(p["s"], p["tid"], p["pid"]) for p in pairs]) for pairs in pdf.pairs]
            yield pd.DataFrame({key: pdf[key], "correct": [sum(s == 1 for s, *_ in g) for g in got], "jaccardSum": [float(sum(s for s, *_ in g)) for g in got]})

    pairs = scored.groupBy(key).agg(F.collect_list(F.struct("s", "tid", "pid")).alias("pairs"))  # many keys a batch, one list a key
    found = pairs.mapInPandas(run, f"{key} {t.schema[key].dataType.simpleString()}, correct long, jaccardSum double")
    out = total.join(found, key, "left").fillna(0, ["correct", "jaccardSum"])
    return out.select(key, "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"), (F.col("jaccardSum") / F.col("total")).alias("meanJaccard"))


def match_floats(left: DataFrame, right: DataFrame, key: str = "doc") -> DataFrame:
    """Each left float in order takes the best unused right block by Dice of 0.6 or more, of ties the later one. Inputs: key, id, ord, words."""
    pairs = dice_pairs(left.withColumnRenamed("id", "lid"), right.withColumnRenamed("id", "rid"), "lid", "rid", key).where(F.col("dice") >= FLOAT_DICE)
    own = pairs.join(left.select(key, F.col("id").alias("lid"), F.col("ord").alias("lo")), [key, "lid"]).join(right.select(key, F.col("id").alias("rid"), F.col("ord").alias("ro")), [key, "rid"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, g in pdf.sort_values(["lo", "dice", "ro"], ascending=[True, False, False]).groupby("lo", sort=True):
            for r in g.itertuples():
                if r.rid not in used:
                    used.add(r.rid)
                    out.append((getattr(r, key), r.lid, r.rid, r.dice))
                    break
        return pd.DataFrame(out, columns=[key, "lid", "rid", "dice"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return own.select(key, "lid", "rid", "lo", "ro", "dice").groupBy(key).applyInPandas(run, f"{key} {kind(left, key)}, lid {kind(left, 'id')}, rid {kind(right, 'id')}, dice double")


def monotone_match(scores: list[list[float]], least: float = PARAGRAPH_OVERLAP) -> list[tuple[int, int]]:
    """Pairs in order on both sides with the greatest sum of scores of ``least`` or more."""
    n, m = len(scores), len(scores[0]) if scores else 0
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            take = scores[i][j] + best[i + 1][j + 1] if scores[i][j] >= least else -1.0
            best[i][j] = max(take, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if scores[i][j] >= least and best[i][j] == scores[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _tokens(s: str) -> list[str]:
    return [w for w in re.sub("[^a-z0-9]+", " ", (s or "").lower()).split() if len(w) > 2 and w not in STOP_WORDS]


def flow_gate(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: do the blocks (doc, ord, text) follow the paragraphs (doc, ord, text)?

    doc, paragraphs, blocks, matched, coverage, inversions, breaks. Paragraphs need eight tokens and
    blocks four. A real inversion covers 0.85 of twelve tokens or more, lies before the cursor and is no repeated copy.
    """
    both = paragraphs.select("doc", F.lit(0).alias("side"), "ord", "text").unionByName(blocks.select("doc", F.lit(1).alias("side"), "ord", "text"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "ord"])
        paras = [t for t in map(_tokens, pdf[pdf.side == 0].text) if len(t) >= 8]
        kept = [(s, t) for s, t in ((s, _tokens(s)) for s in pdf[pdf.side == 1].text) if len(t) >= 4]
        sets = [set(p) for p in paras]
        scores = [[sum(w in s for w in t) / len(t) for _, t in kept] for s in sets]
        pairs = monotone_match(scores)
        at, cursor, inversions = {j: i for i, j in pairs}, -1, 0
        for j, (_, t) in enumerate(kept):
            if j in at:
                cursor = at[j]
            elif len(t) >= 12:
                best = max(range(len(paras)), key=lambda i: scores[i][j], default=None)
                if best is not None and scores[best][j] >= 0.85 and best < cursor and scores[max(cursor, 0)][j] < 0.85:
                    inversions += 1
        breaks = sum(
            bool(re.search(r"[a-z,;-]$", a.strip())) and bool(re.match(r"[A-Z]", b.strip())) for (a, _), (b, _) in zip(kept, kept[1:])
        )
        return pd.DataFrame(
            [(key[0], len(paras), len(kept), len(pairs), len(pairs) / len(kept) if kept else 0.0, inversions, breaks)],
            columns=["doc", "paragraphs", "blocks", "matched", "coverage", "inversions", "breaks"],
        )

    return both.groupBy("doc").applyInPandas(run, "doc long, paragraphs long, blocks long, matched long, coverage double, inversions long, breaks long")


# --- pages: model blocks against text blocks ------------------------------------------------------


def _measured(first: int | None) -> list[Column]:
    """Of a block with its text as ``t``: what is measured of it, whole length, a digest of what is not measured, and the box."""
    whole = first is None
    digest = F.lit(None).cast("string") if whole else F.when(F.length("t") > first, F.sha2("t", 256))
    box = [F.col("box")[x].cast("double").alias(x) for x in ("x0", "y0", "x1", "y1")]
    return [(F.col("t") if whole else F.substring("t", 1, first)).alias("text"), F.length("t").alias("size"), digest.alias("digest"), *box]


def align_blocks(model: DataFrame, layer: DataFrame, key: str = "page", first: int | None = 400) -> DataFrame:
    """Each text block with its best model block: 2 x IoU + (1 - distance) of 0.45 or more; a model block may take many.

    The distance is Levenshtein's of the ``first`` characters, of the whole texts where that is None, over the full greater length;
    1 against empty text. Only the text side is exclusive, so a row number by text block is the whole match. A page is measured at
    once. Inputs: key, id, ord, box, text.
    """
    def side(df, p):
        own = df.select(key, "ord", "id", "box", F.lower(collapse("text")).alias("t"))
        own = own.select(key, F.struct("ord", "id", F.struct(*_measured(first)).alias("own")).alias("own"))
        return own.groupBy(key).agg(F.array_sort(F.collect_list("own")).alias(p))  # of equal scores the first is taken

    pages = side(model, "m").join(side(layer, "t"), key).withColumn("best", _best_of_pages(F.col("m")["own"], F.col("t")["own"]))
    m, t = (lambda p: F.get("m", p["m"])), (lambda p: F.get("t", p["t"]))
    own = lambda p: F.struct(t(p)["id"].alias("tid"), m(p)["id"].alias("mid"), m(p)["ord"].alias("mo"), p["score"].alias("score"))
    scored = pages.select(key, F.inline(F.transform("best", own)))
    w = Window.partitionBy(key, "tid").orderBy(F.col("score").desc(), "mo", "mid")
    return scored.withColumn("k", F.row_number().over(w)).where("k = 1").select(key, "tid", "mid", "score")


def unmatched(layer: DataFrame, aligned: DataFrame, key: str = "page") -> DataFrame:
    return layer.join(aligned.select(key, F.col("tid").alias("id")), [key, "id"], "left_anti")


def _bounds(text: list[str], size: np.ndarray, digest: list, box: np.ndarray, m: np.ndarray, t: np.ndarray):
    """Bounds of the scores of one page's pairs from boxes and lengths alone, some rows of t at a time against all of m.

    (rows, part of the boxes, greater length, whether the score is known, most, least). NaN stands for a null of a box, which
    ``geometry.iou`` passes over.
    """
    number: dict = {}
    code = np.array([number.setdefault(x, len(number)) for x in zip(size.tolist(), text, digest)])
    cut = np.fromiter(map(len, text), np.int64, len(text))
    area = np.fmax(box[:, 2] - box[:, 0], 0) * np.fmax(box[:, 3] - box[:, 1], 0)
    step = max(1, _CELLS_AT_ONCE // len(m))
    for k in range(0, len(t), step):
        own = t[k : k + step, None]
        wide = np.fmax(np.fmin(box[m, 2], box[own, 2]) - np.fmax(box[m, 0], box[own, 0]), 0)
        both = wide * np.fmax(np.fmin(box[m, 3], box[own, 3]) - np.fmax(box[m, 1], box[own, 1]), 0)
        whole = area[m] + area[own] - both
        near = 2 * np.where(whole > 0, both / np.where(whole > 0, whole, 1), 0.0)
        same, longest = code[m] == code[own], np.maximum(np.maximum(size[m], size[own]), 1)
        known = same | (size[m] == 0) | (size[own] == 0)
        within = lambda far: near + np.where(same, 1.0, np.where(known, 0.0, 1 - far / longest))  # noqa: E731, B023
        yield own[:, 0], near, longest, known, within(np.abs(cut[m] - cut[own])), within(np.maximum(cut[m], cut[own]))


def _best(text: list[str], size: np.ndarray, digest: list, box: np.ndarray, models: int) -> list[tuple[int, int, float]]:
    """(text block, model block, score) of one page, whose first blocks are the model's: measured are pairs that can be the best of their text block."""
    out, patterns = [], None
    m = np.argsort(size[:models], kind="stable")
    for own, near, longest, known, most, least in _bounds(text, size, digest, box, m, np.arange(models, len(text))):
        open_ = most >= np.maximum(least.max(1, keepdims=True), ALIGN_CUT) - 1e-9
        score = np.where(open_ & known, most, -np.inf)
        open_ &= ~known
        for r in np.flatnonzero(open_.any(1)):
            patterns = patterns or Patterns([text[i] for i in m])
            at = np.flatnonzero(open_[r])
            far = patterns.distances(text[own[r]], int(at[0]), int(at[-1]) + 1)[at - at[0]]
            score[r, at] = near[r, at] + (1 - far / longest[r, at])
        best = score.max(1)
        out += [(int(own[r]) - models, int(m[score[r] == best[r]].min()), float(best[r])) for r in np.flatnonzero(best >= ALIGN_CUT)]
    return out


_PAIRS = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("m", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@F.arrow_udf(_PAIRS)
def _best_of_pages(model: pa.Array, layer: pa.Array) -> pa.Array:
    def side(lists):
        flat, at = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        box = [flat.field(x).to_numpy(zero_copy_only=False).astype(float) for x in ("x0", "y0", "x1", "y1")]
        return flat.field("text").to_pylist(), flat.field("size").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("digest").to_pylist(), np.stack(box, 1), at

    *m, ma = side(model)
    *t, ta = side(layer)
    join = lambda x, y: x + y if isinstance(x, list) else np.concatenate([x, y])
    own = [_best(*(join(x[a:b], y[c:d]) for x, y in zip(m, t)), int(b - a)) for a, b, c, d in zip(ma, ma[1:], ta, ta[1:])]
    kind = pa.struct([("t", pa.int32()), ("m", pa.int32()), ("score", pa.float64())])
    return pa.array([[{"t": t, "m": m, "score": s} for t, m, s in x] for x in own], pa.list_(kind))


def _missed(text: list[str], size: np.ndarray, digest: list, box: np.ndarray, model: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """Of one page's blocks, which text blocks no model block matches."""
    missed, m, t, patterns = layer.copy(), np.flatnonzero(model), np.flatnonzero(layer), None
    if not len(m):
        return missed
    m = m[np.argsort(size[m], kind="stable")]
    for own, near, longest, known, most, least in _bounds(text, size, digest, box, m, t):
        sure = (np.where(known, least >= ALIGN_CUT, least >= ALIGN_CUT + 1e-9)).any(1)
        missed[own[sure]] = False
        open_ = ~known & (most >= ALIGN_CUT - 1e-9)
        for r in np.flatnonzero(~sure & open_.any(1)):
            patterns = patterns or Patterns([text[i] for i in m])
            at = np.flatnonzero(open_[r])
            far = patterns.distances(text[own[r]], int(at[0]), int(at[-1]) + 1)[at - at[0]]
            missed[own[r]] = not (near[r, at] + (1 - far / longest[r, at]) >= ALIGN_CUT).any()
    return missed


def unmatched_blocks(blocks: DataFrame, key: str = "page", first: int | None = 400) -> DataFrame:
    """(key, id) of the text blocks that ``align_blocks`` leaves without a model block, each page by itself.

    One frame holds both sides: key, id, box, text and two flags, ``model`` and ``layer``; a block may be of both. Whether some pair
    reaches 0.45 takes far fewer distances than which pair is best: blocks that boxes, lengths or equal texts decide are not
    measured. An id that a match takes leaves with all its rows, as by a join; null ids stay, and without a key nothing matches.
    ``first`` as there.
    """
    t = F.lower(collapse("text"))
    own = blocks.select(key, "id", "box", "model", "layer", t.alias("t"))
    part = F.struct("id", "model", "layer", *_measured(first))
    pages = own.groupBy(key).agg(F.collect_list(part).alias("own"))

    def run(batches):
        for b in batches:
            keys, lists = b.column(0), b.column(1)
            flat, at = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            col = {x: flat.field(x) for x in ("model", "layer", "size", "x0", "y0", "x1", "y1")}
            text, digest = flat.field("text").to_pylist(), flat.field("digest").to_pylist()
            model, layer = (col[x].fill_null(False).to_numpy(zero_copy_only=False) for x in ("model", "layer"))
            size = col["size"].to_numpy(zero_copy_only=False).astype(np.int64)
            box = np.stack([col[x].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for x in ("x0", "y0", "x1", "y1")], 1)
            ids, rows, pages_ = flat.field("id"), [], []
            for p, (i, j) in enumerate(zip(at[:-1], at[1:])):
                own = np.flatnonzero(layer[i:j]) + i
                if keys[p].is_valid:
                    missed = _missed(text[i:j], size[i:j], digest[i:j], box[i:j], model[i:j], layer[i:j])
                    named = ids.take(pa.array(own)).to_pylist()
                    taken = {v for v, x in zip(named, own) if not missed[x - i]} - {None}
                    own = [x for v, x in zip(named, own) if v not in taken]
                rows.extend(own), pages_.extend([p] * len(own))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(pages_, pa.int64())), ids.take(pa.array(rows, pa.int64()))], [key, "id"])

    return pages.mapInArrow(run, T.StructType([own.schema[key], own.schema["id"]]))


def filled_gaps(layer: str, model: str, mark: str) -> tuple[int, int]:
    """(gaps, filled): a gap counts as filled when both its contexts stand in the model's text at most 12 characters apart."""
    parts, squeeze = (layer or "").split(mark), lambda s: " ".join(unicodedata.normalize("NFKC", s).split())
    filled = 0
    for a, b in zip(parts, parts[1:]):
        left, right = squeeze(a)[-12:], squeeze(b)[:12]
        at = (model or "").find(left) if len(left) >= 2 and len(right) >= 2 else -1
        end = model.find(right, at + len(left)) if at >= 0 else -1
        filled += end >= 0 and end - at - len(left) <= 12 and mark not in model[at + len(left) : end]
    return len(parts) - 1, filled


def reconcile(model: DataFrame, layer: DataFrame, mark: str, key: str = "page") -> DataFrame:
    """A page's model blocks put right by its text blocks.

    Numbers come from the text layer unless their sentence holds a gap, lost placeholders and sentences are appended (flag
    ``restored``), prose without a text block is flagged ``mm-only``, text blocks left over are inserted by position
    (flag ``inserted``). Result: key, id, ord, text, flags, gaps, filled.
    """
    pairs = align_blocks(model, layer, key)
    box = lambda df, side: df.select(key, F.lit(side).alias("side"), "id", "ord", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), "text")
    own = box(model, 0).unionByName(box(layer, 1)).join(pairs.select(key, F.col("tid").alias("id"), "mid", F.lit(1).alias("side")), [key, "side", "id"], "left")
    number = re.compile(r"(?<![⟦f\d.])\d+(?:\.\d+)?")
    split = lambda s: [x for x in re.split(r"(?<=[.!?。！？])\s+", " ".join((s or "").split())) if x]

    def distance(a, b):
        a, b = a.lower(), b.lower()
        if a == b or not a or not b:
            return 0.0 if a == b else 1.0
        x, y, row = a[:400], b[:400], list(range(len(b[:400]) + 1))
        for i, c in enumerate(x, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1] / max(len(a), len(b))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        texts = pdf[pdf.side == 1]
        for m in pdf[pdf.side == 0].sort_values(["ord", "id"]).itertuples():
            mine = " ".join(texts[texts.mid == m.id].sort_values(["ord", "id"]).text)
            body, flags, gaps, filled = m.text or "", [], 0, 0
            if mine:
                gaps, filled = filled_gaps(mine, body, mark)
                theirs = [(n, next((s for s in split(mine) if n in s), "")) for n in number.findall(mine)]
                it = iter(theirs)
                if len(theirs) == len(number.findall(body)):
                    body = number.sub(lambda x: (lambda n, s: x[0] if mark in s else n)(*next(it)), body)
                for token in re.findall(r"⟦f\d+⟧", mine):
                    if body.count(token) < mine.count(token):
                        body += " " + token
                for s in split(mine):
                    if mark not in s and s not in " ".join(body.split()) and all(distance(s, x) > SENTENCE_DISTANCE for x in split(body)):
                        body, flags = f"{body} {s}".strip(), ["restored"]
            elif re.search(r"[A-Za-z]{4,}", body):
                flags = ["mm-only"]
            out.append([m.x0, m.y0, m.id, body, flags, gaps, filled])
        whole = " ".join(x[3] for x in out)
        for t in texts[texts.mid.isna()].sort_values(["y0", "x0"]).itertuples():
            if t.text and t.text not in whole:
                at = next((k for k, x in enumerate(out) if (x[1], x[0]) > (t.y0, t.x0)), len(out))
                out.insert(at, [t.x0, t.y0, t.id, t.text, ["inserted"], 0, 0])
        k = pdf[key].iloc[0] if len(pdf) else None
        return pd.DataFrame([(k, x[2], n, *x[3:]) for n, x in enumerate(out, 1)], columns=[key, "id", "ord", "text", "flags", "gaps", "filled"])

    return own.groupBy(key).applyInPandas(run, f"{key} {model.schema[key].dataType.simpleString()}, id string, ord int, text string, flags array<string>, gaps int, filled int")


def paragraph_plan(before: DataFrame, after: DataFrame, key: str = "doc") -> DataFrame:
    """Each later paragraph is kept or replaced: the k-th occurrence of a text pairs with the k-th before. Inputs: key, ord, text."""
    norm = F.lower(collapse("text"))
    nth = lambda df: df.select(key, "ord", norm.alias("t")).withColumn("k", F.row_number().over(Window.partitionBy(key, "t").orderBy("ord")))
    old = nth(before).select(key, "t", "k", F.col("ord").alias("was"))
    return nth(after).join(old, [key, "t", "k"], "left").select(key, "ord", "was", F.when(F.col("was").isNull(), "replace").otherwise("keep").alias("action"))


def order_off(aligned: DataFrame, key: str = "page") -> DataFrame:
    """Whether a page's text blocks, in order, meet their model blocks out of order. Input: key, to (order of text), mo (order of model)."""
    w = Window.partitionBy(key).orderBy("to")
    return aligned.withColumn("before", F.lag("mo").over(w)).groupBy(key).agg(F.count_if(F.col("mo") < F.col("before")).alias("inversions")).withColumn("off", F.col("inversions") > 0)


def drop_swapped(blocks: DataFrame, key: str = "page") -> DataFrame:
    """Repeated texts of a page but the first, after a model's page took the place of another; short ones stay."""
    w = Window.partitionBy(key, "norm").orderBy("ord")
    own = blocks.withColumn("norm", F.lower(collapse("text"))).withColumn("k", F.row_number().over(w))
    return own.where((F.col("k") == 1) | (F.length("norm") < 24)).drop("norm", "k")


# --- anchors --------------------------------------------------------------------------------------


def near_pages(notes: DataFrame, pages: DataFrame, reach: int = 1) -> DataFrame:
    """Notes with the pages of their document at most ``reach`` away, as an equality on exploded page numbers."""
    keys = notes.withColumn("__page", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)))
    p = pages.withColumnRenamed("page", "at_page")
    return keys.join(p, (keys["docHash"] == p["docHash"]) & (F.col("__page") == F.col("at_page"))).drop(p["docHash"]).drop("__page")


def anchor_blocks(notes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of each note's anchor: same id, else an alias, else the same head, else the quote; ``lost`` without.

    notes: id, docHash, page, bid, srcHead, quote; blocks: docHash, page, bid, aliases, head, text.
    """
    b = blocks.select("docHash", "page", F.col("bid").alias("to"), "aliases", "head", F.col("text").alias("host"))
    j = near_pages(notes, b)
    how = (
        F.when(F.col("bid") == F.col("to"), 0).when(F.array_contains("aliases", F.col("bid")), 1)
        .when((text("srcHead") != "") & (F.col("srcHead") == F.col("head")), 2)
        .when((text("quote") != "") & F.col("host").contains(F.col("quote")), 3)
    )
    best = j.withColumn("how", how).where("how is not null").groupBy("id").agg(
        F.min(F.struct("how", F.abs(F.col("page") - F.col("at_page")).alias("far"), "at_page", "to")).alias("m")
    )
    name = F.element_at(F.array(*map(F.lit, ["exact", "alias", "head", "quote"])), F.coalesce(F.col("m.how"), F.lit(0)) + 1)
    name = F.when(F.col("m").isNotNull(), name)
    return notes.join(best, "id", "left").select(*notes.columns, F.col("m.to").alias("anchored"), F.col("m.at_page").alias("anchored_page"), F.coalesce(name, F.lit("lost")).alias("status"))


def reanchor(notes: DataFrame, blocks: DataFrame, ready: DataFrame | None = None) -> DataFrame:
    """As ``anchor_blocks`` with drift (another block or page than stored) and, where pages are not ready, status ``pending``."""
    own = anchor_blocks(notes, blocks)
    drift = (F.col("status") != "lost") & ((F.col("anchored") != F.col("bid")) | (F.col("anchored_page") != F.col("page")))
    own = own.withColumn("drift", F.coalesce(drift, F.lit(False)))
    if ready is None:
        return own
    r = ready.select("docHash", "page", F.lit(True).alias("__ready")).distinct()
    own = own.join(r, ["docHash", "page"], "left")
    return own.withColumn("status", F.when(F.col("__ready").isNull() & (F.col("status") == "lost"), "pending").otherwise(F.col("status"))).drop("__ready")


def prior_figure(blocks: DataFrame, by: str = "page") -> DataFrame:
    """Each caption's nearest figure before it on the page."""
    w = Window.partitionBy(by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    fig = F.last(F.when(F.col("label") == "figure", F.col("id")), ignorenulls=True).over(w)
    return blocks.withColumn("figure", F.when(F.col("label") == "caption", fig))


def bind(boxes: DataFrame, targets: DataFrame, key: str = "page", least: float = 0.55, margin: float = 0.08, kinds: bool = False) -> DataFrame:
    """Each box (key, id, box) with the target it overlaps by ``least`` or whose centre it holds, the best ahead by ``margin``; else unbound.

    ``conflict`` marks boxes whose best two are closer than the margin.
    """
    t = targets.select(key, F.col("id").alias("tid"), F.col("box").alias("tb"), *([F.col("kind").alias("tk")] if kinds else []))
    s = geometry.overlap_ratio(F.col("box"), F.col("tb"))
    s = F.greatest(s, F.when(geometry.holds_centre(F.col("tb"), F.col("box")), F.lit(least)).otherwise(0.0))
    j = boxes.join(t, key).withColumn("s", s).where((F.col("s") >= least) & (F.col("kind") == F.col("tk") if kinds else F.lit(True)))
    top = j.groupBy(key, "id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "tid")), False), 1, 2).alias("top"))
    clear = (F.size("top") == 1) | (F.col("top")[0]["s"] - F.try_element_at("top", F.lit(2))["s"] >= margin)
    own = top.select(key, "id", F.when(clear, F.col("top")[0]["tid"]).alias("bound"), (~clear).alias("conflict"))
    return boxes.join(own, [key, "id"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def contained_items(blocks: DataFrame, items: DataFrame, key: str = "page") -> DataFrame:
    """(key, block id, item id) where the item's centre lies in the block's box."""
    i = items.select(key, F.col("id").alias("item"), F.col("box").alias("ib"))
    return blocks.join(i, key).where(geometry.holds_centre(F.col("box"), F.col("ib"))).select(key, "id", "item")


def donate_boxes(model: DataFrame, layer: DataFrame, key: str = "page") -> DataFrame:
    """Model blocks without a box take that of the first text block that holds their first 24 characters."""
    head = F.substring(collapse("text"), 1, 24)
    t = layer.select(key, F.col("ord").alias("to"), F.col("box").alias("tb"), collapse("text").alias("tt"))
    need = model.where("box is null").withColumn("head", head).where("head <> ''")
    got = need.join(t, key).where(F.col("tt").contains(F.col("head"))).groupBy(key, "id").agg(F.min_by("tb", "to").alias("donated"))
    return model.join(got, [key, "id"], "left").withColumn("box", F.coalesce("box", "donated")).drop("donated")


def match_headings(entries: DataFrame, headings: DataFrame, key: str = "doc") -> DataFrame:
    """Outline entries with a heading of the same title, numbers aside, on the same page where both have one: the first that has the
    entry's number or none, as a title may itself begin with a number, else the first.
    """
    whole = lambda c: F.lower(collapse(c))
    fold = lambda c: F.lower(F.regexp_replace(collapse(c), r"^[\dIVX]+(?:\.\d+)*\.?\s+", ""))
    h = headings.select(key, F.struct(F.col("ord").alias("ho"), F.col("id").alias("heading")).alias("h"), F.col("page").alias("hp"), whole("title").alias("hw"), fold("title").alias("hf"))
    h = h.groupBy(key, "hp", "hw", "hf").agg(F.min("h").alias("h")).withColumn("t", F.explode(F.array_distinct(F.array("hw", "hf"))))
    e = entries.withColumn("t", fold("title")).withColumn("ew", whole("title"))
    ok = F.col("page").isNull() | F.col("hp").isNull() | (F.col("page") == F.col("hp"))
    other = ~F.col("hw").isin(F.col("t"), F.col("ew"))
    best = e.join(h, [key, "t"]).where(ok).groupBy(key, "ord").agg(F.min(F.struct(other.alias("other"), "h")).alias("b")).select(key, "ord", F.col("b.h.heading").alias("heading"))
    return e.drop("t", "ew").join(best, [key, "ord"], "left")


def attach_references(formulas: DataFrame, table: DataFrame) -> DataFrame:
    """A formula's reference by id, else by page and equation number."""
    a = table.select(F.col("id"), F.col("latex").alias("by_id")).dropDuplicates(["id"])
    b = table.where("number is not null").select("page", "number", F.col("latex").alias("by_number")).dropDuplicates(["page", "number"])
    return formulas.join(a, "id", "left").join(b, ["page", "number"], "left").withColumn("reference", F.coalesce("by_id", "by_number")).drop("by_id", "by_number")


def nfkc_sentences(c) -> Column:
    return sentences(nfkc(c))
