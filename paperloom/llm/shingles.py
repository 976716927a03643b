"""Near-copies by fingerprints and, beyond their reach, by exact Jaccard similarity of word shingles, candidates from banded minima."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, materialize
from .components import connected_components

WORDS = 5
SEED = 42
#: Bands of minima and minima in each. A pair at Jaccard 0.8 shares no band with a chance of (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
_BLOCK = 2048
#: Rows whose sets are held at once.
TOGETHER = 128
_MULTIPLY, _ADD, _JOIN = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the shingles in rising order; a text of fewer words is one shingle."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # as for the fingerprints
    own = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
    h, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.fromiter((h(s, seed) for s in own), np.uint64))


def number(own: np.ndarray) -> int:
    """A long that stands for the set."""
    return int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _BLOCK):
        np.minimum(least, (own[k : k + _BLOCK, None] * _MULTIPLY + _ADD).min(0), out=least)
    mixed = ((least ^ least >> np.uint64(32)) * _JOIN).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, TOGETHER):
            yield b.slice(k, TOGETHER)


def _numbers(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and size: each set of a bucket with the next one, and whether their sizes allow a similarity of 0.8."""
    last = [np.zeros(0, np.int64)] * 3
    for b in batches:
        if b.num_rows:
            key, node, size = (np.concatenate(x) for x in zip(last, _numbers(b, 3)))
            at = np.flatnonzero(key[1:] == key[:-1])
            u, v = node[at], node[at + 1]
            ok = 5 * size[at] >= 4 * size[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(ok)], ["u", "v", "ok"])
            last = [key[-1:], node[-1:], size[-1:]]


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and size: the pairs of a bucket that lie in different groups, whose sizes allow a similarity of 0.8, but for
    neighbours, which are known."""
    kept = [np.zeros(0, np.int64)] * 4

    def out(key: np.ndarray, node: np.ndarray, size: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.minimum.reduceat(group, starts) != np.maximum.reduceat(group, starts)
        mixed = np.repeat(many, np.diff(np.r_[starts, len(key)]))
        key, node, size, group = (x[mixed] for x in (key, node, size, group))
        at = np.arange(len(key))
        for d in range(2, len(key)):
            at = at[at < len(key) - d]
            at = at[(key[at] == key[at + d]) & (5 * size[at] >= 4 * size[at + d])]  # none further off where this one is not
            if not len(at):
                break
            found = at[group[at] != group[at + d]]
            u, v = node[found], node[found + d]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    for b in batches:
        if b.num_rows:
            kept = [np.concatenate(x) for x in zip(kept, _numbers(b, 4))]
            last = int(np.searchsorted(kept[0], kept[0][-1], "left"))
            yield from out(*(x[:last] for x in kept))
            kept = [x[last:] for x in kept]
    yield from out(*kept)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        sets = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
        good = pa.array([similar(x, y) for x, y in zip(*sets)], pa.bool_())
        yield b.select(["u", "v"]).filter(good)


def near_copies(
    docs: DataFrame, fingerprint: Callable[[str], int], close: Callable[[DataFrame], DataFrame],
    size: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's set (doc_id, set), the sets (set, node: its smallest doc_id), and edges (u, v) between nodes.

    Equal sets are one node. Two sets are candidates if their texts share a ``fingerprint`` (64 bits) or ``close`` links their
    fingerprints (it takes distinct ones, fp and node, and returns edges u and v), and if they share the minima of one of the bands. They are
    linked if the Jaccard similarity of their shingles is 0.8 or more. First what the fingerprints link is verified, and each set of a bucket against the next one
    by size, which joins near copies of one another; then the pairs of a bucket that still lie in different groups are, all of them. The
    edges connect what all pairs at 0.8 connect, and a large group of near copies costs no square of pairs.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = b.column(1).to_pylist()
            own, marks = [shingles(t, size) for t in texts], np.array([fingerprint(t) for t in texts], np.uint64)
            cols = [pa.array([number(s) for s in own], pa.int64()), pa.array([bands(s) for s in own], pa.list_(pa.int64()))]
            cols.append(pa.array([len(s) for s in own], pa.int64()))
            cols.append(pa.array(marks.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "set", "bands", "size", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            own = [shingles(t, size) for t in b.column(1).to_pylist()]
            same = pa.array([number(s) == n for s, n in zip(own, b.column(0).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([s.tobytes() for s in own], pa.binary())], ["set", "node", "own"]).filter(same)

    texts = id_and_text(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(texts.mapInArrow(lean(keyed), "doc_id long, set long, bands array<long>, size long, fp long"), "shingles")
    nodes = rows.where("doc_id is not null").groupBy("set").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.collect_set("fp").alias("fps")
    )
    nodes = materialize(nodes, "sets")
    marks = nodes.select(F.explode("fps").alias("fp"), F.col("set").alias("u"))
    marked = materialize(marks.groupBy("fp").agg(F.min("u").alias("node")), "fingerprints")
    equal = marks.join(marked, "fp").where("u <> node").select("u", F.col("node").alias("v"))
    marked_close = equal.unionByName(close(marked)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(True).alias("ok"))

    def buckets(sets_: DataFrame, *more: str) -> DataFrame:
        by_key = sets_.select(F.explode("bands").alias("key"), "set", "size", *more)
        return by_key.repartition(parts, "key").sortWithinPartitions("key", "size", "set")

    paths = materialize(buckets(nodes).mapInArrow(lean(_paths), "u long, v long, ok boolean").unionByName(marked_close).distinct(), "paths")
    met = materialize(paths.select(F.explode(F.array("u", "v")).alias("set")).distinct(), "met")
    known = nodes.join(met, "set", "left_semi")
    own = texts.join(known.select("set", "node"), F.col("doc_id") == F.col("node")).select("set", "text", "node")
    own = materialize(own.mapInArrow(lean(sets), "set long, node long, own binary").dropDuplicates(["set"]), "candidate-sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (own.select(F.col("set").alias(x), F.col("node").alias(f"{x}_node"), F.col("own").alias(f"{x}_own")) for x in ("u", "v"))
        both = pairs.join(a, "u").join(b, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"), "u_own", "v_own")
        return materialize(both.mapInArrow(lean(_verified), "u long, v long"), name)

    first = verified(paths.where("ok").select("u", "v").distinct(), "near")
    groups = known.join(connected_components(first), "node", "left").withColumn("group", F.coalesce("component", "node"))
    rest = buckets(groups, "group").mapInArrow(lean(_cross), "u long, v long").distinct()
    return rows.select("doc_id", "set"), nodes.select("set", "node"), first.unionByName(verified(rest, "near-across"))
