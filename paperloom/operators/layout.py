"""Reading order from positioned text: lines, columns, paragraphs, blocks, joins across pages.

Items are (doc, page, id, str, x, y, width, height, bold) with y upwards. A page is one group; nothing
is shuffled inside it. Steps that look back over what was built so far run as grouped pandas.
"""

from __future__ import annotations

import re
from collections import Counter, namedtuple
from statistics import mean

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import text as tx

PAGE = ["doc", "page"]
LINE = "doc long, page int, ord int, text string, x double, y double, width double, height double, bold boolean, items array<long>"
GUTTER_SHARE, MAX_DEPTH, ASIDE_BODY, ASIDE_BOX, ASIDE_EDGE, FULL_WIDTH = 0.35, 6, 0.55, 0.34, 0.16, 0.58
BAND_SLACK, CLUSTER_GAP, COLUMN_SLACK = 8, 8, 28


def upper_median(values):
    own = sorted(values)
    return own[len(own) // 2] if own else 0.0


def y_clusters(items: list) -> list[list]:
    """Top-down, then left; an item joins while it is within max(2, 0.45 x its height) of the running mean y."""
    out, total = [], 0.0
    for it in sorted(items, key=lambda i: (-i.y, i.x)):
        if out and abs(it.y - total / len(out[-1])) <= max(2, 0.45 * it.height):
            out[-1].append(it)
            total += it.y
        else:
            out.append([it])
            total = it.y
    return out


def column_split(items: list) -> float | None:
    """The x that parts two columns, by votes of rows whose widest middle gap stands out; the mean of the densest cluster.

    All shares are of the width that the items span; fewer than six items have no columns.
    """
    if len(items) < 6:
        return None
    votes, x0 = [], min(i.x for i in items)
    width = max(1, max(i.x + i.width for i in items) - x0)
    for row in y_clusters(items):
        row = sorted(row, key=lambda i: i.x)
        gaps = []
        for k, (a, b) in enumerate(zip(row, row[1:])):
            end, gap = a.x + a.width, b.x - a.x - a.width
            middle = (end + b.x) / 2
            left, right = row[: k + 1], row[k + 1 :]
            chars = min(len("".join(i.str for i in s).strip()) for s in (left, right))
            wide = min(left[-1].x + left[-1].width - left[0].x, right[-1].x + right[-1].width - right[0].x)
            if 0.25 * width < middle - x0 < 0.75 * width and chars >= 18 and wide > 0.22 * width:
                gaps.append((gap, middle))
        gaps.sort(reverse=True)
        if gaps and gaps[0][0] > max(16, 0.045 * width) and (len(gaps) < 2 or gaps[0][0] > 1.5 * gaps[1][0]):
            votes.append(gaps[0][1])
    return _densest(votes)


def _densest(votes: list[float]) -> float | None:
    """The mean of the densest cluster of votes, two or more."""
    votes.sort()
    best = max(([v for v in votes if 0 <= v - a <= 24] for a in dict.fromkeys(votes)), key=len, default=[])
    if len(best) < 2:
        return None
    return best[0] if best[0] == best[-1] else mean(best)


def _line(row: list) -> dict:
    row = sorted(row, key=lambda i: i.x)
    text, end = "", None
    for it in row:
        if end is not None and it.x - end > 0.18 * max(it.height, 1) and text and not text[-1].isspace() and not it.str[:1].isspace():
            text += " "
        text, end = text + it.str, it.x + it.width
    x0, x1 = min(i.x for i in row), max(i.x + i.width for i in row)
    return dict(
        text=" ".join(text.split()), x=x0, y=upper_median([i.y for i in row]), width=x1 - x0, height=max(i.height for i in row),
        bold=2 * sum(bool(i.bold) for i in row) > len(row), items=[int(i.id) for i in row],
    )


def build_lines(items: list, width: float) -> tuple[list[dict], float | None]:
    """Lines of a page: clusters cut at the split between columns, else at a gap over max(20, a tenth of the width)."""
    split, out = column_split(items), []
    for row in y_clusters(items):
        row = sorted(row, key=lambda i: i.x)
        if split is not None and not any(i.x < split - 4 and i.x + i.width > split + 4 for i in row):
            cut = [[i for i in row if i.x + i.width / 2 < split], [i for i in row if i.x + i.width / 2 >= split]]
        elif split is None:
            gaps = [(b.x - a.x - a.width, k + 1) for k, (a, b) in enumerate(zip(row, row[1:]))]
            gap, k = max(gaps, default=(0, 0))
            cut = [row[:k], row[k:]] if gap > max(20, 0.1 * width) else [row]
        else:
            cut = [row]
        out += [_line(part) for part in cut if part]
    return [x for x in out if x["text"]], split


Item = namedtuple("Item", "id str x y width height bold")


def _starts(new: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(new) + 1))


def _flat_lines(id, str: list, x, y, w, h, bold, width: float) -> tuple[list[dict], float | None] | None:
    """``build_lines`` over columns of a page whose rows stand clear of one another; None where that does not hold.

    Rows of equal y, each further from the next than its items reach, are the clusters without a look at running means;
    without white space inside items, the lengths of joined texts are sums.
    """
    try:
        whole = "".join(str)
    except TypeError:
        return None
    if not str or "" in str or whole.split() != [whole] or not np.isfinite([x, y, w, h]).all() or np.abs(y).max() > 1e9:
        return None
    at = np.lexsort((x, -y))
    x, y, w, h, bold = x[at], y[at], w[at], h[at], bold[at]
    down = y[:-1] - y[1:]
    new = down > 0
    if (down[new] <= np.maximum(2, 0.45 * h[1:][new]) + 1e-3).any():
        return None
    end, row, chars = x + w, np.zeros(len(x), np.int64), np.zeros(len(x) + 1, np.int64)
    np.cumsum(new, out=row[1:])
    np.cumsum(np.fromiter(map(len, str), np.int64, len(str))[at], out=chars[1:])
    start = _starts(new)
    k = np.flatnonzero(~new)  # an item and the next one of its row
    gap, split = x[k + 1] - x[k] - w[k], None
    if len(x) >= 6:
        x0 = x.min()
        span, middle = max(1, end.max() - x0), (end[k] + x[k + 1]) / 2
        first, last = start[row[k]], np.append(start[1:], len(x))[row[k]]
        ok = (0.25 * span < middle - x0) & (middle - x0 < 0.75 * span) & (np.minimum(chars[k + 1] - chars[first], chars[last] - chars[k + 1]) >= 18)
        ok &= np.minimum(end[k] - x[first], end[last - 1] - x[k + 1]) > 0.22 * span
        rows: dict = {}
        for r, pair in zip(row[k[ok]].tolist(), zip(gap[ok].tolist(), middle[ok].tolist())):
            rows.setdefault(r, []).append(pair)
        votes = []
        for gaps in rows.values():
            gaps.sort(reverse=True)
            if gaps[0][0] > max(16, 0.045 * span) and (len(gaps) < 2 or gaps[0][0] > 1.5 * gaps[1][0]):
                votes.append(gaps[0][1])
        split = _densest(votes)
    part = 2 * row
    if split is not None:
        across = np.logical_or.reduceat((x < split - 4) & (end > split + 4), start)
        part = part + ((x + w / 2 >= split) & ~across[row])
        if (part[1:] < part[:-1]).any():
            to = np.argsort(part, kind="stable")
            at, part, x, y, w, h, bold, end = (c[to] for c in (at, part, x, y, w, h, bold, end))
    else:
        cuts: dict = {}
        for j in np.flatnonzero(gap > max(20, 0.1 * width)).tolist():
            r = int(row[k[j]])
            cuts[r] = max(cuts.get(r, (0.0, 0)), (float(gap[j]), int(k[j]) + 1))
        for r, (_, j) in cuts.items():
            part[j:][row[j:] == r] += 1
    start = _starts(part[1:] != part[:-1])
    stop = np.append(start[1:], len(x))
    apart = np.zeros(len(x), bool)
    apart[1:] = x[1:] - end[:-1] > 0.18 * np.maximum(h[1:], 1)
    apart[start] = False
    words, ids = [" " + str[i] if s else str[i] for i, s in zip(at.tolist(), apart.tolist())], id[at].tolist()
    low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(end, start)
    strong = 2 * np.add.reduceat(bold.astype(np.int64), start) > stop - start
    columns = (c.tolist() for c in (start, stop, low, y[start], high - low, np.maximum.reduceat(h, start), strong))
    return [dict(text="".join(words[a:b]), x=l, y=t, width=n, height=tall, bold=s, items=ids[a:b]) for a, b, l, t, n, tall, s in zip(*columns)], split


def column_order(lines: list[dict], split: float | None, width: float) -> list[dict]:
    """Full-width lines part the page into bands; inside a band the left column, then the right."""
    if split is None:
        return sorted(lines, key=lambda l: (-l["y"], l["x"]))
    out, left, right = [], [], []
    for l in sorted(lines, key=lambda l: (-l["y"], l["x"])):
        if l["x"] < split - 4 and l["x"] + l["width"] > split + 4:
            out += left + right + [l]
            left, right = [], []
        else:
            (left if l["x"] + l["width"] / 2 < split else right).append(l)
    return out + left + right


#: A gap that may part columns, votes that are one gutter, and gutters of a page at most.
GUTTER_GAP, GUTTER_NEAR, GUTTERS = 8, 28, 2


def is_prose(s: str) -> bool:
    """Two words of four letters, twelve letters, and half of it letters."""
    letters = len(re.findall("[A-Za-z]", s))
    return len(re.findall("[A-Za-z]{4,}", s)) >= 2 and letters >= 12 and letters >= 0.5 * len(s)


def is_run_in(left: str, right: str) -> bool:
    """A short capitalised heading before the paragraph that it opens."""
    own, right = left.split(), right.strip()
    return 1 <= len(own) <= 4 and not re.search("[.!?:]$", left.strip()) and bool(re.match("[A-Z]", right)) and all(re.match("[A-Z0-9]", w) for w in own)


def prose_gutters(rows: list[list]) -> list[float]:
    """Middles of gaps between prose and prose, voted by the rows of a page: clusters of two votes or more, the two leftmost."""
    votes = []
    for row in rows:
        row = sorted(row, key=lambda i: i.x)
        for k in range(1, len(row)):
            end = row[k - 1].x + row[k - 1].width
            left, right = ("".join(i.str for i in part).strip() for part in (row[:k], row[k:]))
            if row[k].x - end >= GUTTER_GAP and not is_run_in(left, right) and is_prose(left) and is_prose(right):
                votes.append((end + row[k].x) / 2)
    clusters: list[list[float]] = []
    for v in sorted(votes):
        if clusters and v - mean(clusters[-1]) < GUTTER_NEAR:
            clusters[-1].append(v)
        else:
            clusters.append([v])
    return [mean(c) for c in clusters if len(c) >= 2][:GUTTERS]


def column_gutters(items: DataFrame) -> DataFrame:
    """(doc, page, gutters) of every page: the x of its gutters, none, one or two."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc": [key[0]], "page": [key[1]], "gutters": [prose_gutters(y_clusters(list(pdf.itertuples())))]})

    return items.groupBy(*PAGE).applyInPandas(run, "doc long, page int, gutters array<double>")


def gutters(lines: list[dict]) -> list[float]:
    """Middles of empty runs of the x histogram, at most two, a tenth and more of the width apart."""
    x0, x1 = min(l["x"] for l in lines), max(l["x"] + l["width"] for l in lines)
    width = x1 - x0
    n = int(max(48, width / 4))
    cover = [0] * n
    for l in lines:
        for b in range(max(0, int((l["x"] - x0) / width * n)), min(n, int((l["x"] + l["width"] - x0) / width * n) + 1)):
            cover[b] += 1
    peak, runs, start = max(cover), [], None
    for b in range(n + 1):
        low = b < n and cover[b] <= GUTTER_SHARE * peak
        if low and start is None:
            start = b
        if not low and start is not None:
            if start > 0.12 * n and b < 0.88 * n:
                runs.append((b - start, (start + b) / 2))
            start = None
    out = []
    for size, mid in sorted(runs, reverse=True):
        if size / n * width >= 8 and all(abs(mid - o) >= 0.12 * n for o in out):
            out.append(mid)
    return [x0 + m / n * width for m in sorted(out[:2])]


def xy_cut(lines: list[dict], depth: int = 0) -> list[dict]:
    """Recursive cuts: full-width lines part strips, gutters part columns; a narrow column at an edge goes last."""
    lines = [l for l in lines if l["text"].strip()]
    down = sorted(lines, key=lambda l: (-l["y"], l["x"]))
    if len(lines) < 2 or depth > MAX_DEPTH:
        return down
    x0, x1 = min(l["x"] for l in lines), max(l["x"] + l["width"] for l in lines)
    full = [l["width"] > FULL_WIDTH * (x1 - x0) for l in down]
    if any(full) and not all(full):
        out, strip = [], []
        for l, f in zip(down, full):
            if f:
                out += xy_cut(strip, depth + 1) + [l]
                strip = []
            else:
                strip.append(l)
        return out + xy_cut(strip, depth + 1)
    cuts = gutters(lines)
    if not cuts:
        return down
    cols: list[list[dict]] = [[] for _ in range(len(cuts) + 1)]
    for l in lines:
        cols[sum(l["x"] + l["width"] / 2 > c for c in cuts)].append(l)
    cols = [c for c in cols if c]
    if len(cols) < 2:
        return down
    span = lambda c: (min(l["x"] for l in c), max(l["x"] + l["width"] for l in c))
    widest = max(b - a for a, b in map(span, cols))
    aside = []
    for c in cols:
        a, b = span(c)
        edge = a - x0 < ASIDE_EDGE * (x1 - x0) or x1 - b < ASIDE_EDGE * (x1 - x0)
        aside.append(b - a < ASIDE_BODY * widest and b - a < ASIDE_BOX * (x1 - x0) and edge)
    order = [c for c, s in zip(cols, aside) if not s] + [c for c, s in zip(cols, aside) if s]
    return [l for c in order for l in xy_cut(c, depth + 1)]


def _pages(run):
    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, page = pdf.doc.iloc[0], pdf.page.iloc[0]
        rows = run(pdf)
        return pd.DataFrame([{"doc": doc, "page": page, "ord": k, **r} for k, r in enumerate(rows)])

    return grouped


def lines(items: DataFrame, width: float = 612.0, order: str = "columns") -> DataFrame:
    """Lines in reading order, ``columns`` by the page's split or ``xy-cut``."""

    def run(pdf):
        own, split = build_lines([i for i in pdf.itertuples() if i.str and i.str.strip()], width)
        return xy_cut(own) if order == "xy-cut" else column_order(own, split, width)

    columns = ["doc", "page", "ord", "text", "x", "y", "width", "height", "bold", "items"]
    return items.groupBy(*PAGE).applyInPandas(lambda pdf: _pages(run)(pdf).reindex(columns=columns), LINE)


_FORMULA = re.compile(r"[=∑∫√≤≥∈]")
_HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+[A-Z]|abstract$|introduction$|references$|conclusions?$)", re.I)


def split_paragraphs(rows: list[dict]) -> list[list[dict]]:
    """Lines in order as paragraphs."""
    if not rows:
        return []
    leads = [a["y"] - b["y"] for a, b in zip(rows, rows[1:]) if a["y"] > b["y"]]
    lead, tall = upper_median(leads) or 1.0, Counter(round(r["height"]) for r in rows)
    typical = min(h for h, n in tall.items() if n == max(tall.values())) or 1
    wide = upper_median([r["width"] for r in rows])
    out, titled = [[rows[0]]], [bool(_HEADING.match(r["text"])) for r in rows]
    for a, b, over, own in zip(rows, rows[1:], titled, titled[1:]):
        gap = a["y"] - b["y"]
        formula = bool(_FORMULA.search(b["text"])) and not re.search(r"[A-Za-z]{4,}.*[A-Za-z]{4,}", b["text"])
        heading = own or over or a["bold"] != b["bold"]
        same_title = a["bold"] and b["bold"] and abs(a["height"] - b["height"]) < 0.6 and 0 < gap <= 1.45 * lead
        up = gap < 0 and bool(re.match(r"[A-Z]", b["text"]))
        short = a["width"] < 0.72 * wide and bool(re.search(r"[.!?:]$", a["text"]))
        new = formula or gap > 1.45 * lead or gap > 3 * typical or up or short or (heading and not same_title)
        if new:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def dehyphen(a: str, b: str) -> str:
    return a[:-1] + b if "-" in a[-2:] and re.search(r"[A-Za-z]-$", a) and re.match(r"[a-z]", b) else f"{a} {b}".strip()


BLOCK = "doc long, page int, ord int, label string, text string, x0 double, y0 double, x1 double, y1 double, items array<long>"


def _chrome(item, width: float, height: float):
    return F.coalesce(tx.is_page_chrome_item(item("str"), item("x"), item("y"), item("height"), F.lit(height), F.lit(width)), F.lit(False))


def blocks(items: DataFrame, width: float = 612.0, height: float = 792.0, drop_chrome: bool = True) -> DataFrame:
    """Blocks of a page's text layer: chrome dropped, lines, paragraphs, labels (title, heading, formula, caption, text)."""
    own = items.where(~_chrome(F.col, width, height)) if drop_chrome else items
    pages = own.groupBy(*PAGE).agg(F.collect_list(F.struct(*Item._fields)).alias("own"))
    return blocks_of_pages(pages, width, height, False)


def blocks_of_pages(pages: DataFrame, width: float = 612.0, height: float = 792.0, drop_chrome: bool = True) -> DataFrame:
    """As ``blocks`` of pages whose items are already together: doc, page and ``own``, an array of items without doc and page."""
    own = F.filter("own", lambda i: ~_chrome(lambda c: i[c], width, height)) if drop_chrome else F.col("own")

    def run(batches):
        for b in batches:
            doc, page, own = b.columns
            flat, at = own.flatten(), np.r_[0, np.cumsum(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].tolist()
            ids, texts = flat.field("id").to_numpy(zero_copy_only=False), flat.field("str").to_numpy(zero_copy_only=False).tolist()
            place = [flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "width", "height")]
            bold, rows, which, ords = flat.field("bold").fill_null(False).to_numpy(zero_copy_only=False), [], [], []
            for p, (i, j) in enumerate(zip(at, at[1:])):
                got = _page_blocks(ids[i:j], texts[i:j], *(c[i:j] for c in place), bold[i:j], width)
                rows += got
                which += [p] * len(got)
                ords += range(len(got))
            col = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 4, pa.list_(pa.int64())]
            to = pa.array(which, pa.int64())
            arrays = [doc.take(to), page.take(to), pa.array(ords, pa.int32()), *(pa.array(c, k) for c, k in zip(col, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "page", "ord", "label", "text", "x0", "y0", "x1", "y1", "items"])

    return pages.select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), own.alias("own")).mapInArrow(run, BLOCK)


def _page_blocks(ids, texts: list, x, y, w, h, bold, width: float) -> list[tuple]:
    """(label, text, x0, y0, x1, y1, items) of one page's blocks in reading order."""
    found = _flat_lines(ids, texts, x, y, w, h, bold, width)
    if found is None:
        items = map(Item, ids.tolist(), texts, x.tolist(), y.tolist(), w.tolist(), h.tolist(), bold.tolist())
        found = build_lines([i for i in items if i.str and i.str.strip()], width)
    own, split = found
    paras, tall = split_paragraphs(column_order(own, split, width)), upper_median([l["height"] for l in own])
    out = []
    for k, p in enumerate(paras):
        text, done = "", []
        for l in p:  # lines to which nothing is joined any more are set aside, as a paragraph may have very many
            if text and "-" not in text[-2:]:
                done.append(text)
                text = l["text"]
            else:
                text = dehyphen(text, l["text"]) if text else l["text"]
        text = " ".join([*done, text])
        if re.match(r"^(?:Figure|Fig\.?|Table)\s*\d", text):
            label = "caption"
        elif k == 0 and p[0]["height"] > 1.3 * tall:
            label = "title"
        elif _HEADING.match(text) or (all(l["bold"] for l in p) and len(text) < 120):
            label = "heading"
        elif _FORMULA.search(text) and not re.search(r"[A-Za-z]{4,}.*[A-Za-z]{4,}", text):
            label = "formula"
        else:
            label = "text"
        box = min(l["x"] for l in p), min(l["y"] for l in p), max(l["x"] + l["width"] for l in p), max(l["y"] + l["height"] for l in p)
        out.append((label, text, *box, [i for l in p for i in l["items"]]))
    return out


# --- joins of what a break parted -----------------------------------------------------------------


def continues(a, b, same_page: bool):
    """Column test: the text b goes on from a."""
    open_end = ~a.rlike(r"[.!?。！？:;]['\")\]]*\s*$")
    low = b.rlike(r"^\s*[a-z]")
    hyphen = a.rlike(r"[A-Za-z]-\s*$") & low
    prose = b.rlike("[A-Za-z]{3,}") & ~b.rlike(r"[{};]\s*$")
    once = ~b.rlike(r"[.!?]\s+[A-Z].*[.!?]\s+[A-Z]") if same_page else F.lit(True)
    return hyphen | (open_end & low & prose & once)


def _joined(a, b):
    return F.when(a.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat_ws(" ", a, b))


def join_flow(rows: DataFrame) -> DataFrame:
    """Text blocks of a page that go on in the next: tails are skipped and point to their host, whose text is joined. Running it again changes nothing.

    Chains are islands of a running sum, so no step looks back over results.
    """
    w = Window.partitionBy(*PAGE).orderBy("ord")
    prose = F.col("label") == "text"
    own = rows.where(prose).withColumn("tail", F.coalesce(continues(F.lag("text").over(w), F.col("text"), True), F.lit(False)))
    own = own.withColumn("chain", F.sum(F.when(F.col("tail"), 0).otherwise(1)).over(w))
    g = own.groupBy(*PAGE, "chain").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("m"))
    g = g.select(*PAGE, F.col("m")[0]["ord"].alias("flow_host"), F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.col("m")[0]["text"], lambda a, x: _joined(a, x["text"])).alias("joined"), F.explode("m.ord").alias("ord"))
    out = rows.join(g, [*PAGE, "ord"], "left")
    head = F.col("flow_host").isNull() | (F.col("flow_host") == F.col("ord"))
    return out.withColumn("text", F.when(head, F.coalesce("joined", "text")).otherwise(F.col("text"))).withColumn("skip", ~head).withColumn(
        "flow_host", F.when(~head, F.col("flow_host"))
    ).drop("joined")


def join_pages(rows: DataFrame) -> DataFrame:
    """(doc, page, ord, next_page, next_ord): a page's last text block that goes on in the next page's first."""
    t = rows.where("label = 'text'")
    ends = t.groupBy(*PAGE).agg(F.min_by(F.struct("ord", "text"), "ord").alias("first"), F.max_by(F.struct("ord", "text"), "ord").alias("last"))
    w = Window.partitionBy("doc").orderBy("page")
    own = ends.withColumn("np", F.lead("page").over(w)).withColumn("nf", F.lead("first").over(w)).where("np = page + 1")
    return own.where(continues(F.col("last.text"), F.col("nf.text"), False)).select("doc", "page", F.col("last.ord").alias("ord"), F.col("np").alias("next_page"), F.col("nf.ord").alias("next_ord"))


# --- set-oriented geometry ------------------------------------------------------------------------


def merge_bands(rects: DataFrame, slack: int = BAND_SLACK) -> DataFrame:
    """Vertical bands (doc, page, top, bottom) of rectangles that touch within the slack."""
    w = Window.partitionBy(*PAGE).orderBy("top", "bottom")
    reach = F.max("bottom").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = rects.withColumn("new", F.when(F.col("top") <= reach + slack, 0).otherwise(1)).withColumn("band", F.sum("new").over(w))
    return own.groupBy(*PAGE, "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def uncovered(rects: DataFrame, width: float, least: float = 24.0) -> DataFrame:
    """Gaps between consecutive bands of at least that height."""
    w = Window.partitionBy(*PAGE).orderBy("top")
    own = merge_bands(rects).withColumn("next", F.lead("top").over(w))
    return own.where(F.col("next") - F.col("bottom") >= least).select(*PAGE, F.lit(0.0).alias("x0"), F.col("bottom").alias("top"), F.lit(width).alias("x1"), F.col("next").alias("bottom"))


def largest_cluster(hits: DataFrame, key: str = "doc", gap: int = CLUSTER_GAP) -> DataFrame:
    """Sorted positions part where they are more than ``gap`` apart; the first largest cluster's (start, end, n)."""
    w = Window.partitionBy(key).orderBy("pos")
    own = hits.withColumn("c", F.sum(F.when(F.col("pos") - F.lag("pos").over(w) > gap, 1).otherwise(0)).over(w))
    g = own.groupBy(key, "c").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"))
    return g.groupBy(key).agg(F.max_by(F.struct("start", "end", "n"), F.struct("n", -F.col("c"))).alias("m")).select(key, "m.*")


def typical_height(items: DataFrame) -> DataFrame:
    """The commonest rounded height of a page, the smaller of a tie."""
    own = items.groupBy(*PAGE, F.floor(F.col("height") + 0.5).alias("h")).count()
    return own.groupBy(*PAGE).agg(F.max_by("h", F.struct("count", -F.col("h"))).alias("typical"))


def column_cut(elements: DataFrame, least: int = 8) -> DataFrame:
    """The left edge, right of the first, where ``least`` elements start within 28 units: a second column."""
    w = Window.partitionBy(*PAGE).orderBy("x0").rangeBetween(0, COLUMN_SLACK)
    own = elements.withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    g = own.groupBy(*PAGE).agg(F.min("x0").alias("first"), F.array_sort(F.collect_set("x0")).alias("xs"))
    return g.select(*PAGE, F.try_element_at(F.filter("xs", lambda x: x > F.col("first") + 4 * COLUMN_SLACK), F.lit(1)).alias("cut"))


def attach_captions(visuals: DataFrame, captions: DataFrame, page_width: float) -> DataFrame:
    """Each figure with the first caption below it within a fifth of the width, overlapping in x."""
    c = captions.select(*PAGE, F.col("id").alias("caption"), F.col("ord").alias("co"), F.col("box").alias("cb"))
    j = visuals.join(c, PAGE)
    fits = (F.col("cb.y0") >= F.col("box.y1") - 4) & (F.col("cb.y0") - F.col("box.y1") < 0.2 * page_width) & (F.least("cb.x1", "box.x1") > F.greatest("cb.x0", "box.x0"))
    return visuals.join(j.where(fits).groupBy(*PAGE, "id").agg(F.min_by("caption", "co").alias("caption")), [*PAGE, "id"], "left")


def relabel_references(rows: DataFrame) -> DataFrame:
    """From a references heading on, text is to be skipped; another heading of an appendix ends that."""
    w = Window.partitionBy("doc").orderBy("page", "ord")
    mark = F.when(tx.matches(tx.collapse("text"), r"(?i)^(?:\d+\.?\s*)?(?:references|bibliography)$"), True).when(
        (F.col("label") == "heading") & tx.matches(tx.collapse("text"), "(?i)^(?:appendix|supplement)"), False
    )
    return rows.withColumn("skip", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def sentence_breaks(rows: DataFrame, key: str = "doc") -> DataFrame:
    """Blocks that begin in the middle of a sentence that the block before did not end."""
    w = Window.partitionBy(key).orderBy("ord")
    before = F.lag("text").over(w)
    return rows.withColumn("mid_break", F.coalesce(before.rlike(r"[A-Za-z,;]\s*$") & F.col("text").rlike(r"^\s*[a-z]"), F.lit(False)))


def outline(layouts: DataFrame) -> DataFrame:
    """Headings with level and number: from a dotted number, roman numerals or appendix letters as one level."""
    t = tx.collapse("text")
    num = F.regexp_extract(t, r"^(\d+(?:\.\d+)*|[IVXLC]+(?=\.)|[A-H](?=\.\d|\s+[A-Z]))", 1)
    level = F.when(num == "", 1).otherwise(F.least(F.size(F.split(num, r"\.")), F.lit(3)))
    return layouts.where(F.col("label") == "heading").select("doc", "page", "ord", t.alias("title"), F.when(num != "", num).alias("number"), level.alias("level"))


def flatten_outline(entries: DataFrame, depth: int = 3) -> DataFrame:
    """A nested outline (title, page, items...) to rows with a path and a level of at most ``depth``."""
    cur, out = entries.select("doc", F.posexplode("items").alias("k", "i")).select("doc", F.array("k").alias("path"), F.lit(1).alias("level"), "i"), []
    for level in range(1, depth + 1):
        out.append(cur.select("doc", "path", "level", F.col("i.title").alias("title"), F.col("i.page").alias("page")))
        names = cur.schema["i"].dataType.names
        if "items" not in names or level == depth:
            break
        cur = cur.select("doc", "path", F.posexplode("i.items").alias("k", "j")).select("doc", F.concat("path", F.array("k")).alias("path"), F.lit(level + 1).alias("level"), F.col("j").alias("i"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def current_entry(entries: DataFrame, line: float) -> DataFrame:
    """The last outline entry at or above a reading line (y downwards), else the first."""
    at = F.when(F.col("y") <= line, F.col("y"))
    return entries.groupBy("doc").agg(F.coalesce(F.max_by("title", F.struct(at, F.col("ord"))), F.min_by("title", "ord")).alias("title"))


PRELABEL = "page int, id long, line int, role string, label string, confidence double"


def prelabel(elements: DataFrame) -> DataFrame:
    """First labels of glyphs (page, id, char, font, x0, y0, x1, y1): formula, text or code, with scripts by size and shift.

    Lines by baseline within max(2.5, 0.45 x height) of the running mean; body height is the value at three quarters; a script
    is at most 78 % of it and shifted by 12 % or more.
    """
    math, code = re.compile(tx.MATH_FACES.replace("(?i)", ""), re.I), re.compile(tx.CODE_FACES.replace("(?i)", ""), re.I)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, out = sorted(pdf.itertuples(), key=lambda e: (e.y1, e.x0)), []
        groups, total = [], 0.0
        for e in rows:
            if groups and abs(e.y1 - total / len(groups[-1])) <= max(2.5, 0.45 * (e.y1 - e.y0)):
                groups[-1].append(e)
                total += e.y1
            else:
                groups.append([e])
                total = e.y1
        for k, g in enumerate(groups):
            heights = sorted(e.y1 - e.y0 for e in g)
            body, base = heights[min(len(heights) - 1, int(0.75 * len(heights)))], upper_median([e.y1 for e in g])
            for e in g:
                h, shift = e.y1 - e.y0, base - e.y1
                script = h <= 0.78 * body and abs(shift) >= 0.12 * body
                role = ("sup" if shift > 0 else "sub") if script else "base"
                font = e.font or ""
                if math.search(font):
                    label, conf = "formula", 0.95
                elif code.search(font):
                    label, conf = "code", 0.9
                elif _FORMULA.search(e.char or "") or script:
                    label, conf = "formula", 0.7
                else:
                    label, conf = "text", 0.85
                out.append((e.page, e.id, k, role, label, conf))
        return pd.DataFrame(out, columns=["page", "id", "line", "role", "label", "confidence"])

    return elements.groupBy("page").applyInPandas(run, PRELABEL)


def prelabel_units(labelled: DataFrame, elements: DataFrame, page_width: float) -> DataFrame:
    """Runs of formula glyphs of a line as units: display if numbered, wide with little prose, or centred; confidence the least."""
    e = labelled.join(elements.select("page", "id", "char", "x0", "y0", "x1", "y1"), ["page", "id"])
    w = Window.partitionBy("page", "line").orderBy("x0", "id")
    f = F.col("label") == "formula"
    e = e.withColumn("run", F.sum(F.when(f & (F.lag("label").over(w) == "formula"), 0).otherwise(1)).over(w))
    prose = e.groupBy("page", "line").agg(F.sum(F.when(~f, F.length("char")).otherwise(0)).alias("prose"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "char"))), lambda s: s["char"]), "").alias("whole"))
    u = e.where(f).groupBy("page", "line", "run").agg(
        F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("elementIds"), F.min("confidence").alias("confidence"), geometry.union_agg(F.struct("x0", "y0", "x1", "y1")).alias("box")
    ).join(prose, ["page", "line"])
    wide, mid = F.col("box.x1") - F.col("box.x0"), (F.col("box.x1") + F.col("box.x0")) / 2
    centred = F.abs(mid - page_width / 2) < 0.08 * page_width
    numbered = F.col("whole").rlike(r"\(\d{1,3}[a-z]?\)$")
    display = numbered | ((wide > 0.32 * page_width) & (F.col("prose") < 8)) | (centred & (wide > 0.16 * page_width) & (F.col("prose") < 16))
    return u.select("page", F.when(display, "display").otherwise("inline").alias("type"), numbered.alias("equationNumber"), "confidence", "elementIds", "box")


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Elements with their unit as edited (page, id, unitId, equationNumber): merges and splits alike name the new unit."""
    e = edits.select("page", "id", F.col("unitId").alias("nu"), F.col("equationNumber").alias("ne"), F.lit(True).alias("hit"))
    return elements.join(e, ["page", "id"], "left").withColumn("unitId", F.when(F.col("hit"), F.col("nu")).otherwise(F.col("unitId"))).withColumn(
        "equationNumber", F.coalesce("ne", "equationNumber")
    ).drop("nu", "ne", "hit")


def insert_by_position(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Blocks with restored ones put in by top band, then left."""
    both = rows.unionByName(more, allowMissingColumns=True)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("box.y0") / 4), "box.x0", "id")))


def block_pairs(rows: DataFrame, translations: DataFrame, width: float, height: float) -> DataFrame:
    """Blocks with their translation and their box in percent of the page."""
    return rows.join(translations.select("bid", "translation"), "bid", "left").withColumn("percent", geometry.percent(F.col("box"), F.lit(width), F.lit(height)))


def page_schedule(pages: DataFrame, visible: int) -> DataFrame:
    """Pages in the order in which to work: the visible one, those within two of it, the rest; nearer first, then by number."""
    far = F.abs(F.col("page") - visible)
    return pages.withColumn("band", F.when(far == 0, 0).when(far <= 2, 1).otherwise(2)).orderBy("band", far, "page")


def content_fingerprint(pages: DataFrame, items: DataFrame) -> DataFrame:
    """SHA-256 of a document's pages (doc, page, width, height) and text items (doc, page, id, str, x, y) in order, free of file dates."""
    r2 = lambda c: F.regexp_replace(F.format_string("%.2f", F.floor(F.col(c) * 100 + 0.5) / 100), r"\.?0+$", "")
    head = pages.select("doc", "page", F.lit(-1).cast("long").alias("id"), F.concat(F.lit("page:"), "page", F.lit(":"), r2("width"), F.lit("x"), r2("height")).alias("line"))
    rows = items.select("doc", "page", F.col("id").cast("long").alias("id"), F.concat(tx.text("str"), F.lit("\t"), r2("x"), F.lit(","), r2("y")).alias("line"))
    own = head.unionByName(rows).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "id", "line"))).alias("l"), F.count_if(F.col("id") == -1).alias("n"))
    whole = F.concat(F.lit("pages:"), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return own.select("doc", F.sha2(whole, 256).alias("fingerprint"))


def assemble_elements(glyphs: DataFrame, paints: DataFrame, paths: DataFrame, images: DataFrame) -> DataFrame:
    """One element for each text glyph, unbound painted outline, path and image of a page, with its kind and source.

    Inputs: page, id, box, and char, font (glyphs) or d (the others). A painted outline that a glyph holds or overlaps is that glyph; an unbound one
    keeps no letter, so that it cannot take a neighbour's.
    """
    from . import match

    bound = match.bind(paints, glyphs)
    none, path = F.lit(""), lambda c: F.when(tx.text(c) != "", F.substring(F.sha2(tx.text(c), 256), 1, 12)).otherwise("")
    row = lambda df, kind, source, char=none, font=none, h=none: df.select("page", "id", "box", F.lit(kind).alias("kind"), char.alias("char"), font.alias("font"), h.alias("pathHash"), F.lit(source).alias("source"))
    parts = [
        row(glyphs, "glyph", "text", tx.text("char"), tx.text("font")), row(bound.where("bound is null"), "glyph", "unbound-paint", h=path("d")),
        row(paths, "path", "path", h=path("d")), row(images, "image", "image", h=path("d")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def restamp(blocks: DataFrame, seed) -> DataFrame:
    """Blocks with the id that follows from ``seed`` (a column), the one that they had kept as an alias if it differs; ids themselves stay.

    Of equal seeds of a page the first by top, left and order has the plain id, the others a number; blocks without a seed keep what they have.
    """
    from ..functions import ids

    own = blocks.withColumn("__seed", seed)
    w = Window.partitionBy(*PAGE, "__seed").orderBy(F.col("box.y0").asc_nulls_last(), F.col("box.x0").asc_nulls_last(), "ord")
    k = F.row_number().over(w)
    fresh = F.concat(F.lit("b"), ids.fnv36(F.col("__seed")), F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""))
    own = own.withColumn("__new", F.when(F.col("__seed") != "", fresh).otherwise(F.col("bid")))
    old = F.filter(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(tx.text("bid"))), lambda a: (a != "") & ~a.eqNullSafe(F.col("__new")))
    return own.withColumn("aliases", old).withColumn("bid", F.col("__new")).drop("__new", "__seed")


def splice_pieces(source, plans):
    """Array of (type, text) from a text and its plans, an array of (start, end, latex): text between, and formulas in place of what they cover.

    Plans are taken by start, then end; one that begins before the last taken one ends, leaves the text or covers white space or one placeholder alone is
    passed over. Null where none is taken.
    """
    piece = "array<struct<type:string,text:string>>"
    sorted_plans = F.array_sort(F.filter(plans, lambda p: p["start"].isNotNull() & p["end"].isNotNull()))
    covered = lambda p: F.substr(source, p["start"] + 1, p["end"] - p["start"])
    good = lambda a, p: (p["start"] >= a["at"]) & (p["end"] >= p["start"]) & (p["end"] <= F.length(source)) & ~covered(p).rlike(rf"^\s*(?:{tx.PLACEHOLDER})?\s*$")
    between = lambda a, p: F.when(p["start"] > a["at"], F.array(F.struct(F.lit("text").alias("type"), F.substr(source, a["at"] + 1, p["start"] - a["at"]).alias("text")))).otherwise(F.array().cast(piece))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(piece).alias("pieces"), F.lit(False).alias("used"))

    def step(a, p):
        math = F.when(tx.text(p["latex"]) != "", F.array(F.struct(F.lit("math").alias("type"), p["latex"].alias("text")))).otherwise(F.array().cast(piece))
        taken = F.struct(p["end"].cast("int").alias("at"), F.concat(a["pieces"], between(a, p), math).alias("pieces"), (a["used"] | (tx.text(p["latex"]) != "")).alias("used"))
        return F.when(good(a, p), taken).otherwise(a)

    def finish(a):
        rest = F.when(a["at"] < F.length(source), F.array(F.struct(F.lit("text").alias("type"), F.substr(source, a["at"] + 1).alias("text")))).otherwise(F.array().cast(piece))
        return F.when(a["used"], F.concat(a["pieces"], rest))

    return F.aggregate(sorted_plans, begin, step, finish)
