"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_and_text, lean

WINDOW = 5
SIMILARITY = 0.8
#: Windows with fewer plain words say too little and count on neither side.
PLAIN_WORDS = 3
#: A part of the benchmark that is broadcast holds at most so many characters; a larger benchmark takes more passes.
PART_CHARS = 8_000_000
#: The memory of words is emptied beyond so many; it only saves time.
WORDS_KEPT = 400_000
#: Documents whose words are looked up together.
TOGETHER = 256
#: Words read as units.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ml l litre litres liter liters "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees watt watts volt volts".split()
)
_NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*%?")
_NUMBER_UNIT = re.compile(r"([+-]?[0-9][0-9.,]*)([^\W\d_]+)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = re.compile(r"[.!?:;][\"')\]]*$")
NUM, UNIT, NAME, NUM_UNIT = "<num>", "<unit>", "<name>", "<num><unit>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bare(word: str) -> str:
    return _EDGE.sub("", word) or word


def canonical(word: str, starts: bool) -> str:
    """A word's token in the template; a capital begins a name only inside a sentence."""
    own = bare(word)
    if _NUMBER.fullmatch(own):
        return NUM
    if (m := _NUMBER_UNIT.fullmatch(own)) and m[2].lower() in UNITS:
        return NUM_UNIT
    if own.lower() in UNITS:
        return UNIT
    if not starts and own[:1].isupper() and own[1:] and not own.isupper():
        return NAME
    return own.lower()


def templates(words: list[str]) -> list[str]:
    return [canonical(w, k == 0 or bool(_ENDS.search(words[k - 1]))) for k, w in enumerate(words)]


class Windows(dict):
    """Windows of a part of the benchmark by their hash, and the numbers of its tokens by word as it stands in a text.

    A word's number has the token inside a sentence in its low 24 bits, the one at a start in the
    next 24, and above them whether it ends a sentence. Words outside the benchmark are 0, so windows with one are never hashed.
    """

    def __init__(self, items: list[tuple[int, str]]):
        super().__init__()
        self.ids = [i for i, _ in items]
        self.words = [t.split() for _, t in items]
        self.tokens = [templates(w) for w in self.words]
        self.number: dict[str, int] = {NUM: 1, UNIT: 2, NAME: 3, NUM_UNIT: 4}
        for tokens in self.tokens:
            for t in tokens:
                self.number.setdefault(t, len(self.number) + 1)
        found = []
        self.total = []
        for k, tokens in enumerate(self.tokens):
            at, h = self.hashes(np.array([self.number[t] for t in tokens], np.int64))
            self.total.append(len(at))
            found += [(int(x), k, int(p)) for x, p in zip(h, at)]
        found.sort()
        self.short, self.short_ids = [], {}
        for k, tokens in enumerate(self.tokens):
            if tokens and not self.total[k]:
                first = self.words[k][0]  # a copy may begin inside a sentence
                forms = {self.number.setdefault(canonical(first, x), len(self.number) + 1) for x in (False, True)}
                self.short.append((k, forms))
                self.short_ids[k] = np.array([self.number[t] for t in tokens], np.int64)
        self.hash = np.array([f[0] for f in found], np.uint64)
        self.item = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)

    def __missing__(self, word: str) -> int:
        get = self.number.get
        value = get(canonical(word, False), 0) | get(canonical(word, True), 0) << 24 | int(bool(_ENDS.search(word))) << 48
        self[word] = value
        return value

    @staticmethod
    def hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of known tokens with enough plain words."""
        n = len(ids) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok, plain = np.cumsum(np.r_[0, ids == 0]), np.cumsum(np.r_[0, ids > 4])
        at = np.flatnonzero((ok[WINDOW:] == ok[:n]) & (plain[WINDOW:] - plain[:n] >= PLAIN_WORDS))
        own = ids.astype(np.uint64)
        h = np.zeros(len(at), np.uint64)
        for k in range(WINDOW):
            h += own[at + k] * _MIX[k]
        return at, h ^ h >> np.uint64(29)

    def matches(self, texts: list[str], least: float) -> Iterator[tuple[int, int, float, str]]:
        """(row, item, similarity, kind) of every text that holds a share of at least ``least`` of an item's windows."""
        if len(self) > WORDS_KEPT:
            self.clear()
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        gap = WINDOW
        starts = np.cumsum(np.r_[gap, sizes[:-1] + gap]) if len(words) else np.zeros(0, np.int64)
        packed = np.full(int(sizes.sum()) + gap * (len(words) + 1), 1 << 48, np.int64)
        for w, s in zip(words, starts):
            packed[s : s + len(w)] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
        begins = np.r_[True, packed[:-1] >> 48 > 0]
        ids = np.where(begins, packed >> 24, packed) & 0xFFFFFF
        if self.short:
            yield from self.whole(ids, starts, words)
        at, h = self.hashes(ids)
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        row = np.searchsorted(starts, at[hit], "right") - 1
        by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for r, p, a, b in zip(row.tolist(), at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            for k in range(a, b):
                by[r, int(self.item[k])].append((p - int(starts[r]), int(self.place[k])))
        for (r, item), pairs in sorted(by.items()):
            if len({q for _, q in pairs}) >= least * self.total[item] and (best := self.occurrence(words[r], item, pairs, least)):
                yield r, self.ids[item], *best

    def values(self, words: list[str], item: int, pairs: list[tuple[int, int]]) -> dict[int | str, tuple[str, str]] | None:
        """The item's and the text's value of each slot; None if a slot has several.

        A number or unit is bound by its place in the item, as equal ones may be replaced by different ones. A name is bound by what it
        says: it stays one name throughout.
        """
        out: dict[int | str, tuple[str, str]] = {}
        for p, q in pairs:
            for k in range(q, q + WINDOW):
                if self.slot(item, k):
                    both = bare(self.words[item][k]), bare(words[p + k - q])
                    if out.setdefault(both[0] if self.tokens[item][k] == NAME else k, both) != both:
                        return None
        return out

    def slot(self, item: int, q: int) -> bool:
        token = self.tokens[item][q]
        return token[0] == "<" and self.number[token] <= 4

    def occurrence(self, words: list[str], item: int, pairs: list[tuple[int, int]], least: float) -> tuple[float, str] | None:
        """The best place in a text: share of the item's windows, and whether slots hold the same or other values.

        Hits further apart than twice the item's length are separate occurrences. One counts only if
        its slots are consistent: each number's place and each name of the item stands for a single value of the text. Hits that are
        not consistent together are judged by alignment: see ``aligned``.
        """
        span, groups = 2 * len(self.tokens[item]), []
        for p in sorted(pairs):
            if groups and p[0] - groups[-1][-1][0] <= span:
                groups[-1].append(p)
            else:
                groups.append([p])
        best = None
        for group in groups:
            if len({q for _, q in group}) < least * self.total[item]:
                continue
            whole = self.values(words, item, group)
            found = [(group, whole)] if whole is not None else self.aligned(words, item, group)
            for hits, values in found:
                share = len({q for _, q in hits}) / self.total[item]
                if share >= least:
                    kind = "verbatim" if all(x == v for x, v in values.values()) else "reparameterised"
                    best = max(best or (0.0, ""), (share, kind))
        return best

    def aligned(self, words: list[str], item: int, group: list[tuple[int, int]]) -> Iterator[tuple[list, dict]]:
        """Consistent hits and their values for every diagonal (place in the text less place in the item).

        A diagonal whose own hits are inconsistent is no occurrence. To each other one, the windows that
        it lacks are added from the nearest diagonals, no further off than the item is long, where all keep
        to its values: edits shift the rest of an item.
        """
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, q in group:
            by[p - q].append((p, q))
        held = {d: v for d, hits in by.items() if (v := self.values(words, item, hits)) is not None}
        order, length = sorted(held), len(self.tokens[item])
        for d in order:
            hits, values, seen = list(by[d]), dict(held[d]), {q for _, q in by[d]}
            near = order[bisect_left(order, d - length) : bisect_right(order, d + length)]
            for other in sorted(near, key=lambda x: abs(x - d)):
                more = [h for h in by[other] if h[1] not in seen]
                own = self.values(words, item, more) if more else None
                if own and any(values.get(x, v) != v for x, v in own.items()) or own is None:
                    continue
                hits += more
                seen.update(q for _, q in more)
                values |= own
            yield hits, values

    def whole(self, ids: np.ndarray, starts: np.ndarray, words: list[list[str]]) -> Iterator[tuple[int, int, float, str]]:
        """(row, item, 1, kind) of texts that hold the whole template of an item without windows.

        Below three plain words, only the same values count.
        """
        for item, forms in self.short:
            n, found = len(self.tokens[item]), {}
            if n > len(ids):
                continue
            plain = sum(not self.slot(item, k) for k in range(n))
            for at in np.flatnonzero(np.isin(ids[: len(ids) - n + 1], list(forms))):
                if n > 1 and (ids[at + 1 : at + n] != self.short_ids[item][1:]).any():
                    continue
                r = int(np.searchsorted(starts, at, "right")) - 1
                text, values, good = words[r][at - starts[r] : at - starts[r] + n], {}, True
                for k, own in enumerate(map(bare, text)):
                    name = bare(self.words[item][k])
                    if self.slot(item, k):
                        good &= values.setdefault(name if self.tokens[item][k] == NAME else k, (name, own))[1] == own
                    elif k == 0:
                        good &= own.lower() == name.lower()
                same = all(x == v for x, v in values.values())
                if good and (same or plain >= PLAIN_WORDS):
                    found[r] = max(found.get(r, ""), "verbatim" if same else "reparameterised")
            yield from ((r, self.ids[item], 1.0, kind) for r, kind in found.items())


def parts(benchmark: DataFrame, part_chars: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Windows]:
    """The benchmark in parts of about ``part_chars`` characters each, read one after another: the driver holds one at a time."""
    own = id_and_text(benchmark, id_col, text_col).where("text <> ''")
    size = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // part_chars))
    of = lambda k: own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k) if n > 1 else own
    for k in range(n):
        yield Windows([(r["doc_id"], r["text"]) for r in of(k).orderBy("doc_id", "text").collect()])


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for k in range(0, b.num_rows, TOGETHER):
        yield b.slice(k, TOGETHER)


def matches(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, part_chars: int = PART_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, similarity, kind for every document that holds an item of the benchmark.

    Texts become templates: numbers, units and names (capitals inside a sentence) are placeholders,
    other words lower case without edge punctuation. Windows of five tokens, three of them plain
    words at least, are joined by hash. An item is found where one place in the document holds at least ``least`` of
    its windows, aligned where hits disagree, and the slots are consistent; an item without such a window is found
    by its whole template. ``kind`` tells ``verbatim`` from ``reparameterised``.

    Null and empty texts match nothing; every input row is judged by itself, so repeated
    rows give repeated matches; equal items all match. Empty tables give no rows. The windows are
    broadcast in parts of bounded size; documents are never shuffled.
    """
    own = id_and_text(docs, id_col, text_col)

    def found(windows: Windows) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _blocks(b):
                    rows = list(held.value.matches(part.column(1).to_pylist(), least))
                    ids = part.column(0).to_pylist()
                    cols = ([ids[r[0]] for r in rows], *([r[k] for r in rows] for k in (1, 2, 3)))
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "similarity", "kind"]
                    )

        return own.mapInArrow(lean(run), "doc_id long, item_id long, similarity double, kind string")

    return reduce(DataFrame.unionByName, map(found, parts(benchmark, part_chars)))


def clean(
    docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, part_chars: int = PART_CHARS, text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark; all columns as they are, no shuffle.

    Null and empty texts stay; every row is judged by itself, so repeated rows share one fate; an empty benchmark takes
    nothing away, and an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    for windows in parts(benchmark, part_chars):
        held = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in _blocks(b):
                    texts = [t or "" for t in part.column(text_col).to_pylist()]
                    gone = {r[0] for r in held.value.matches(texts, least)}
                    yield part.filter(pa.array([k not in gone for k in range(part.num_rows)])) if gone else part

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
