"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hold_out, id_and_text, lean, slices

#: Labelled rows that the index is fitted on at most: those of the smallest hash of their id.
EXAMPLES = 4000
NEIGHBOURS = 20
BLOCK = 64
#: Blocks that are scored before bounds are first held against the k-th cosine.
FIRST_BLOCKS = 16
#: Terms that stand in most examples: their postings are full columns, multiplied for ``TOGETHER`` texts at once; a block's bound holds
#: their exact part.
COMMON, TOGETHER = 512, 128
#: Weight of the overall rate among a vote's neighbours.
PRIOR_WEIGHT = 1.0
#: A term's idf is multiplied by this and by how many standard errors it is commoner in toxic examples, where it is;
#: the errors are those of so many holders more at the overall rate.
LEAST_RELEVANCE, SHRINK = 0.1, 10.0
#: Least score of a rejected document.
REJECT = 0.3
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to each end, one range after another, and the range of each."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(size) + size, size), of


def relevance(toxic: np.ndarray, held: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Factors of the idf by the number of toxic examples and of all examples that hold each term."""
    p = n_toxic / n if n else 0.0
    if not 0 < p < 1:
        return np.full(len(held), 1.0)
    return LEAST_RELEVANCE + np.maximum(0.0, (toxic - p * held) / np.sqrt((held + SHRINK) * p * (1 - p)))


class Index:
    """Examples as unit vectors over all their terms, in an inverted index with the greatest weight in each block.

    A term weighs (1 + ln count) * idf * relevance. A word that stands in no example counts in a
    text's length as a term of one document. Examples of equal counts are one entry with a count of each label.
    """

    def __init__(self, terms: list[str], df: np.ndarray, total: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.terms = {t: k for k, t in enumerate(terms)}
        self.names = terms
        own: dict[bytes, list] = {}
        for i, y, t, c in sorted(examples, key=lambda e: e[0]):
            key = np.asarray(t, np.int64).tobytes() + np.asarray(c, np.int64).tobytes()
            own.setdefault(key, [np.asarray(t, np.int64), np.asarray(c, float), []])[2].append((i, y))
        labels = [y for _, _, members in own.values() for _, y in members]
        self.rate = (sum(labels) + 1) / (len(labels) + 2)
        held, toxic = np.zeros(len(terms)), np.zeros(len(terms))
        for t, _, members in own.values():
            held[t] += len(members)
            toxic[t] += sum(y for _, y in members)
        idf = np.log((1 + total) / (1 + np.append(np.asarray(df, float)[: len(terms)], 0))) + 1e-3
        self.weight = idf * np.append(relevance(toxic, held, sum(labels), len(labels)), LEAST_RELEVANCE)
        none = [y for t, _, members in own.values() if not len(t) for _, y in members]
        self.empty_score = (sum(none) + self.rate) / (len(none) + 1)
        entries = [(self.unit(t, c, 0), members) for t, c, members in own.values() if len(t)]
        # examples of like labels and like heaviest terms share blocks, so that bounds tell them apart
        entries.sort(key=lambda e: (-sum(y for _, y in e[1]) / len(e[1]), int(e[0][0][np.argmax(e[0][1])]), e[1]))
        self.ids = [[i for i, _ in m] for _, m in entries]
        self.size = [len(m) for _, m in entries]
        self.toxic = [sum(y for _, y in m) for _, m in entries]
        vectors = [v for v, _ in entries]
        self.blocks = max(1, -(-len(entries) // BLOCK))
        self.block_start, self.block_of = np.arange(0, len(entries), BLOCK), np.arange(len(entries)) // BLOCK
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        value = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        often = np.argsort(-np.bincount(term, minlength=len(terms)), kind="stable")[:COMMON]
        self.column = np.full(len(terms), -1, np.int64)  # of the common terms
        self.column[often] = np.arange(len(often))
        self.full = np.zeros((len(often), len(vectors)))
        common = self.column[term] >= 0
        self.full[self.column[term[common]], doc[common]] = value[common]
        term, doc, value = term[~common], doc[~common], value[~common]
        order = np.lexsort((doc, term))
        term, self.doc, self.value = term[order], doc[order].astype(np.int32), value[order]
        block = self.doc // BLOCK
        begins = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        # a run is the postings of a term in a block
        self.run_start = np.r_[begins, len(term)]
        self.run_block = block[begins]
        self.run_max = np.maximum.reduceat(self.value, begins) if len(begins) else np.zeros(0)
        self.term_runs = np.searchsorted(term[begins], np.arange(len(terms) + 1))
        self.steps: tuple[list[float], list[float]] = ([], [])
        self.calibrate(vectors)

    def unit(self, t: np.ndarray, c: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of terms and their counts; ``unknown`` is the sum of squares of (1 + ln count) of other words."""
        w = (1 + np.log(c)) * self.weight[t]
        norm = np.sqrt(w @ w + unknown * self.weight[-1] ** 2)
        return t, w / norm if norm > 0 else w

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray, float, bool]:
        """Terms of a text, their counts, the squares of other words, and whether it has words."""
        found = Counter(words(text))
        t = np.fromiter(map(self.terms.get, found, repeat(-1)), np.int64, len(found))
        c = np.fromiter(found.values(), float, len(found))
        known = t >= 0
        return t[known], c[known], float(((1 + np.log(c[~known])) ** 2).sum()), bool(found)

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each query (a row) with each entry."""
        q = np.zeros((len(queries), len(self.full)))
        for row, (t, w) in zip(q, queries):
            at = self.column[t]
            row[at[at >= 0]] = w[at >= 0]
        return q @ self.full

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, base: np.ndarray | None = None) -> list[tuple[float, int]]:
        """The ``k`` entries of the greatest cosine (positive; ties by their order), found exactly.

        Blocks are scored in falling order of their bounds, a few at a time, until no bound exceeds the k-th cosine. ``base`` is the
        query's row of ``common_part``.
        """
        if not self.ids:
            return []
        if base is None:
            base = self.common_part([(t, w)])[0]
        rare = self.column[t] < 0
        t, w = t[rare], w[rare]
        run, of = ranges(self.term_runs[t], self.term_runs[t + 1])
        at_block, weight = self.run_block[run], w[of]
        bound = np.bincount(at_block, self.run_max[run] * weight, self.blocks) + np.maximum.reduceat(base, self.block_start)
        first = np.argpartition(bound, -FIRST_BLOCKS)[-FIRST_BLOCKS:] if self.blocks > FIRST_BLOCKS else np.arange(self.blocks)
        best = self.scored(first, base, run, at_block, weight, k)
        least = best[-1][0] if len(best) == k else 0.0
        bound[first] = -1.0
        rest = np.flatnonzero(bound > max(0.0, least - 1e-9))
        return heapq.nsmallest(k, best + self.scored(rest, base, run, at_block, weight, k), key=lambda e: (-e[0], e[1])) if len(rest) else best

    def scored(self, blocks: np.ndarray, base: np.ndarray, run: np.ndarray, at_block: np.ndarray, weight: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best entries of some blocks, from the common part and the runs of the query's other terms there."""
        chosen = np.zeros(self.blocks, bool)
        chosen[blocks] = True
        on = np.flatnonzero(chosen[at_block])
        own = run[on]
        post, of_run = ranges(self.run_start[own], self.run_start[own + 1])
        score = np.round(base + np.bincount(self.doc[post], self.value[post] * weight[on][of_run], len(base)), 12)
        score[~chosen[self.block_of]] = 0.0
        hits = np.flatnonzero(score > 0)
        if len(hits) > k:
            cut = np.partition(score[hits], len(hits) - k)[len(hits) - k]
            hits = hits[score[hits] >= cut]
        best = sorted(zip((-score[hits]).tolist(), hits.tolist()))[:k]
        return [(-s, d) for s, d in best]

    def vote(self, near: list[tuple[float, int]], without: int = -1, label: int = 0) -> float:
        """Labels of the nearest examples weighted by the inverse of their distance, with the overall rate as one
        neighbour more. Of an entry that holds more than are still asked for, each label counts by its share.
        ``without``: one example of that label of this entry is left out."""
        total, toxic, left = PRIOR_WEIGHT, PRIOR_WEIGHT * self.rate, NEIGHBOURS
        for s, d in near:
            n, y = self.size[d] - (d == without), self.toxic[d] - (d == without) * label
            take = min(n, left)
            if take:
                w = take / (0.1 + max(0.0, 1 - s))
                total, toxic, left = total + w, toxic + w * y / n, left - take
            if not left:
                break
        return toxic / total

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Isotonic steps from votes to rates, straight between them; each example's vote is taken without itself."""
        votes = []
        for d, (t, w) in enumerate(vectors):
            if d % TOGETHER == 0:
                base = self.common_part(vectors[d : d + TOGETHER])
            near = self.nearest(t, w, NEIGHBOURS + 1, base[d % TOGETHER])
            for label, n in ((0, self.size[d] - self.toxic[d]), (1, self.toxic[d])):
                if n:
                    votes.append((self.vote(near, d, label), label * n, n))
        pools: list[list[float]] = []
        for v, y, n in sorted(votes):
            pools.append([v, v, y, n])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                _, last, y2, n2 = pools.pop()
                pools[-1][1:] = [last, pools[-1][2] + y2, pools[-1][3] + n2]
        rates = [(p[2] + self.rate) / (p[3] + 1) for p in pools]
        self.steps = ([v for p in pools for v in p[:2]], [r for r in rates for _ in range(2)])

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[int], list[str]]]:
        """Of each text its score, ids of the nearest examples, and the terms that weigh most in the text's own vector."""
        for k in range(0, len(texts), TOGETHER):
            counted = [self.counts(x) for x in texts[k : k + TOGETHER]]
            queries = [self.unit(t, c, unknown) for t, c, unknown, _ in counted]
            for (t, w), row, (*_, any_words) in zip(queries, self.common_part(queries), counted):
                if not any_words:
                    yield self.empty_score, [], []
                    continue
                near = self.nearest(t, w, NEIGHBOURS, row)
                v = self.vote(near)
                top = t[np.lexsort((t, -w))[:5]] if near else []
                yield float(np.interp(v, *self.steps)) if self.steps[1] else v, [i for _, d in near for i in self.ids[d][:3]][:3], [self.names[x] for x in top]


def _chosen(labels: DataFrame, examples: int, id_col: str) -> DataFrame:
    """own_id, toxic of at most ``examples`` labelled ids that are not held out."""
    known = labels.select(F.col(id_col).cast("long").alias("own_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("own_id is not null and toxic in (0, 1)").where(~hold_out("own_id", 4, 2))
    chosen = known.groupBy("own_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("own_id"), "own_id").limit(examples)
    return labels.sparkSession.createDataFrame(chosen.toArrow())  # bounded by ``examples``; rows of Python objects would go through more workers


def _examples(own: DataFrame, chosen: DataFrame) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], list[str]]:
    """(own_id, toxic, numbers of terms, counts) of the chosen documents, and the terms in order; read one partition after another, so that
    the driver holds numbers and each term once. Of several rows of one id that of the smallest digest counts, so there are no more than
    chosen ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sorted(Counter(words(t)).items()) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([hashlib.md5(t.encode("utf-8", "replace")).digest() for t in b.column(2).to_pylist()], pa.binary()),
                 pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))],
                ["own_id", "toxic", "digest", "terms", "counts"],
            )

    sample = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("own_id")).select("own_id", "toxic", "text")
    counted = sample.mapInArrow(lean(run), "own_id long, toxic int, digest binary, terms array<string>, counts array<long>")
    one = counted.groupBy("own_id").agg(F.min(F.struct("digest", "toxic", "terms", "counts")).alias("e"))
    number: dict[str, int] = {}
    found = []
    for r in one.toLocalIterator():
        t = np.array([number.setdefault(x, len(number)) for x in r["e"]["terms"]], np.int32)
        found.append((r["own_id"], r["e"]["toxic"], t, np.array(r["e"]["counts"], np.int32)))
    names = sorted(number)
    place = np.empty(len(names), np.int32)
    for k, x in enumerate(names):
        place[number[x]] = k
    ordered = []
    for i, y, t, c in found:
        by = np.argsort(place[t])
        ordered.append((i, y, place[t][by], c[by]))
    return ordered, names


def _frequencies(own: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the examples stands, and how many documents there are."""
    held = own.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n = held.value.get, len(held.value)
        found = np.zeros(n + 1, np.int64)
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                at = [k for x in set(words(t)) if (k := get(x)) is not None]
                found[at] += 1
                found[n] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "n"])

    counted = own.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)  # at most the examples' terms
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    held.unpersist()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index over every term of at most ``examples`` labelled documents that are not held out: those of the smallest
    hash of their id; of several labels of one id the greatest holds. Document frequencies are counted over all documents."""
    own = id_and_text(docs, id_col, text_col)
    found, names = _examples(own, _chosen(labels, examples, id_col))
    df, total = _frequencies(own, {x: k for k, x in enumerate(names)})
    return Index(names, df, total, found)


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), evidence (ids of the nearest examples), terms (the weightiest); one row for each input row.

    Null text and text without words get the rate of such examples and no evidence; a text that shares no term with an
    example the rate of all. With no labels, or labels of one kind, scores are smoothed rates of the labels.
    Repeated rows score alike; an empty table gives no rows; other columns are not read. No text is shuffled but for the
    examples' counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = list(held.value.scores(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.string()))],
                ["doc_id", "score", "evidence", "terms"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double, evidence array<long>, terms array<string>")


def keep(docs: DataFrame, labels: DataFrame, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``reject``, with all columns and without a shuffle of texts.

    Null and empty texts score as in ``score`` and equal rows share one fate; an empty table gives none, and without labels
    all score one half, so a table without labels must be caught by the caller's choice of ``reject``.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in slices(batches):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array([s < reject for s, *_ in own.scores(texts)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
