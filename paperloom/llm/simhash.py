"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean, materialize
from .components import connected_components, forest
from .shingles import WORDS, near_copies

SEED = 42
#: First bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of up to so many fingerprints is compared pair by pair; larger ones are split by keys of the third segment first.
BUCKET_PAIRS = 64
_BLOCK = 1 << 16
_GENERATOR = 0b101011100011  # of the (23, 12) Golay code


def fingerprint(text: str, size: int = 3) -> int:
    """64 bits; one is set if it is set in over half the shingles' XXH64."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # A-Z only; splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    h, seed = xxhash.xxh64_intdigest, SEED
    n, counts = 0, np.zeros(64, np.int64)
    hashes = (h(s, seed) for s in shingles)
    total = max(1, len(words) - size + 1)
    while n < total:
        block = np.fromiter(hashes, np.uint64, count=min(_BLOCK, total - n))
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), a row for each input row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, fp long")


class Golay:
    """Decoder of the perfect binary Golay code: every 23-bit word is within 3 bits of one codeword."""

    def __init__(self):
        rest = []
        for i in range(23):
            r = 1 << i
            for k in range(i, 10, -1):
                if r >> k & 1:
                    r ^= _GENERATOR << (k - 11)
            rest.append(r)
        self.syndrome_of_high = np.zeros(1 << 12, np.int64)
        for i in range(12):
            self.syndrome_of_high[1 << i : 2 << i] = self.syndrome_of_high[: 1 << i] ^ rest[11 + i]
        self.error = np.zeros(1 << 11, np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                s = 0
                for i in bits:
                    s ^= rest[i]
                self.error[s] = sum(1 << i for i in bits)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the nearest codeword."""
        syndrome = self.syndrome_of_high[words >> 11] ^ (words & 0x7FF)
        return (words ^ self.error[syndrome]) >> 11


_golay: list[Golay] = []


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint.

    At most 2 errors over three segments leave some segment without one and its successor with at
    most one (going round, both (2,0,0) and (1,1,0) do in each order). So a key is a segment
    as it is, with an index of the next one: the indices of the codewords nearest to that segment
    and to its neighbours at one bit. Two words at one bit share such an index, as each one's own
    nearest codeword is among the other's.
    """
    rows, out = [], []
    segment = _segments(fp)
    for t in range(3):
        row, index = _near(segment[(t + 1) % 3], SEGMENTS[(t + 1) % 3][1])
        rows.append(row)
        out.append(t << 40 | segment[t][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(out)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(a) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]


def _near(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords nearest to each word and to its neighbours at one bit."""
    if not _golay:
        _golay.append(Golay())
    flips = np.array([0, *(1 << i for i in range(width))], np.int64)
    index = np.sort(_golay[0].index(words[:, None] ^ flips), axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    row, col = np.nonzero(new)
    return row, index[row, col]


def finer_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) that split the buckets of ``keys`` by the segment that they leave open.

    It differs in at most 2 bits. Two words at 2 bits have a neighbour at one bit in common, and so its index.
    """
    segment, of = _segments(fp), key >> 40
    rows, out = [], []
    for t in range(3):
        own, k = np.flatnonzero(of == t), (t + 2) % 3
        row, index = _near(segment[k][own], SEGMENTS[k][1])
        rows.append(own[row])
        out.append(key[own[row]] << 12 | index)  # t, 22 bits and two indices: 48 bits
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row, key = keys(fp.astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, fp, node = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        row, finer = finer_keys(key, fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(fp[row]), pa.array(node[row])], ["key", "fp", "node"])


def _close(max_bits: int, bucket: float):
    """Over rows sorted by key: links inside buckets of up to ``bucket`` rows (u, v), members of larger ones (u, key, fp)."""

    def out(u, v, key, fp) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, key, fp)], ["u", "v", "key", "fp"])

    def members(key, fp, node) -> pa.RecordBatch:
        return out(node, [None] * len(node), key, fp)

    def links(key, fp, node) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > bucket, sizes)
        if big.any():
            yield members(key[big], fp[big], node[big])
            key, fp, node = key[~big], fp[~big], node[~big]
        same = np.arange(len(key))
        for d in range(1, len(key)):
            same = same[same < len(key) - d]
            same = same[key[same + d] == key[same]]
            if not len(same):
                break
            near = same[np.bitwise_count((fp[same] ^ fp[same + d]).view(np.uint64)) <= max_bits]
            if len(near):
                none = [None] * len(near)
                yield out(node[near], node[near + d], none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        large = None
        for b in batches:
            if not b.num_rows:
                continue
            key, fp, node = (np.concatenate([k, b.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept))
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                yield members(key[:n], fp[:n], node[:n])
                key, fp, node = key[n:], fp[n:], node[n:]
                if not len(key):
                    kept = [np.zeros(0, np.int64)] * 3
                    continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield from links(key[:last], fp[:last], node[:last])
            kept, large = [key[last:], fp[last:], node[last:]], None
            if len(kept[0]) > bucket:
                yield members(*kept)
                large, kept = int(key[-1]), [np.zeros(0, np.int64)] * 3
        if len(kept[0]):
            yield from links(*kept)

    return run


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all ``nodes`` (fp, node; distinct fp) at 2 or fewer differing bits.

    One shuffle of some 16 keys a distinct fingerprint, sorted by key and compared in place. A bucket
    has distinct fingerprints that agree in a segment, so copies do not fill it. The few buckets too large
    for pairs are split by Golay indices of the remaining segment and dealt anew, so no task keeps them; what shares
    all three is compared in blocks, and only a spanning forest of what each task finds is written.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_key = nodes.select("fp", "node").mapInArrow(lean(_keyed), "key long, fp long, node long")
    sorted_keys = by_key.repartition(parts, "key").sortWithinPartitions("key")
    found = materialize(sorted_keys.mapInArrow(lean(_close(2, BUCKET_PAIRS)), "u long, v long, key long, fp long"), "links")
    pairs = found.where("v is not null").select("u", "v")
    crowded = found.where("v is null").select("key", "fp", F.col("u").alias("node"))
    finer = crowded.mapInArrow(lean(_finer), "key long, fp long, node long").repartition(parts, "key").sortWithinPartitions("key")
    close = _close(2, float("inf"))
    joined = finer.mapInArrow(lean(lambda batches: forest(close(batches))), "u long, v long")  # one worker a task for both
    return pairs.unionByName(materialize(joined, "forest"))


def near_duplicates(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) for every row.

    Null or blank text has the fingerprint zero and is linked like any other. Repeated rows share a
    fingerprint and so a component; rows without an id are kept and take the component of their
    fingerprint. An empty table gives no rows.
    """
    own = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    linked = connected_components(links(nodes.where("node is not null")))
    placed = nodes.join(linked, "node", "left").select(
        F.col("fp").alias("own_fp"), F.coalesce("component", "node").alias("component_id")
    )
    return own.join(placed, F.col("fp") == F.col("own_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, whole and with all columns.

    Texts are linked where the Jaccard similarity of their five-word shingles is 0.8 or more. Candidates are the texts that Golay keys
    link at two bits or fewer of their fingerprints, as in ``near_duplicates``, each verified. Many pairs at 0.8 differ in some ten of 64
    bits, which no such keys reach, so banded minima add the candidates beyond.
    """
    rows, nodes, edges = near_copies(docs, fingerprint, links, size, id_col, text_col)
    placed = nodes.join(connected_components(edges), "node", "left").select("set", F.coalesce("component", "node").alias("kept"))
    gone = rows.join(placed, "set").where("doc_id <> kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
