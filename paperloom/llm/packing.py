"""Best-fit packing of token pieces, after dominance reduction."""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, kept, lean, materialize, slices

CAPACITY = 1024
END_ID = 2
#: The encoder's memory of words is emptied beyond so many; it only saves time.
WORDS_KEPT = 400_000
#: A space that has white space at its side; without one, every space begins a token of its own.
_ODD_SPACE = re.compile(r"\s |^ | $| \s")


class Encoder(dict):
    """Ids of the byte-level BPE at ``tokenizer`` as little-endian uint32 bytes.

    A single space between two other characters always begins a token, so a text is the sum of
    the words between such spaces; words are looked up here, unknown ones encoded once. The
    vocabulary is read from the ``tokenizers`` file; the merging itself is done by tiktoken over
    the same ranks, which gives the same ids in a quarter of the time (tests compare them).
    Texts that hold a string of the file's added tokens are cut at those first, as ``tokenizers`` does.
    """

    def __init__(self, tokenizer: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        path = public_tokenizers.path(tokenizer)
        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)

    def ids(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.ids(" " + word)
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return np.array(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if _ODD_SPACE.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        if len(self) > WORDS_KEPT:
            self.clear()
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker."""
    return kept(tokenizer, lambda: Encoder(tokenizer))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        tail = end_id.to_bytes(4, "little")
        for b in slices(batches):
            doc, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                all_ids = enc.encode(text) + tail
                for k, (s, n) in enumerate(cut(len(all_ids) // 4, capacity)):
                    own = all_ids[4 * s : 4 * (s + n)]
                    doc.append(d), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(own)), rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(memoryview(own).cast("I").tolist())
            cols = [
                pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32()))), names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


# --- the plan, over counts of lengths ------------------------------------------------------------


def reduce_by_dominance(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Martello and Toth's reduction over counts of sizes: (times, sizes of one sequence) fixed, and what is left.

    For the largest size j, a set that holds j is fixed when it dominates every other feasible set
    that holds j: j alone if nothing fits beside it; j and j* (the largest that fits) if they fill
    the sequence, if no two sizes fit beside j, or if j* is no smaller than the best pair where no
    three fit; j, j* and the largest third b if no feasible pair holds a smaller member above b.
    Equal sizes are interchangeable, so a set is fixed as many times as its members last.
    """
    left = {s: n for s, n in count.items() if n > 0}
    fixed: list[tuple[int, list[int]]] = []

    def fix(sizes: list[int]) -> None:
        need: dict[int, int] = {}
        for s in sizes:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // k for s, k in need.items())
        fixed.append((times, sizes))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]

    def smallest(k: int, without: int) -> int | None:
        """Sum of the k smallest items besides one of size ``without``."""
        total = 0
        for s in sorted(left):
            have = left[s] - (s == without)
            take = min(k, have)
            total, k = total + take * s, k - take
            if not k:
                return total
        return None

    def largest(limit: int, *used: int) -> int | None:
        return max((s for s, n in left.items() if s <= limit and n > used.count(s)), default=None)

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                star = largest(room, j)
                if star is None:
                    fix([j])
                elif star == room or (two := smallest(2, j)) is None or two > room:
                    fix([j, star])
                elif (three := smallest(3, j)) is None or three > room:
                    best = 0
                    for s in left:
                        other = largest(min(room - s, s), j, s) if left[s] > (s == j) else None
                        best = max(best, s + other if other else 0)
                    b = largest(min(room - star, star), j, star)
                    above = min((s for s in left if b is not None and s > b), default=None)
                    if star >= best:
                        fix([j, star])
                    elif b is not None and (above is None or 2 * above > room):
                        fix([j, star, b])
                    else:
                        break
                else:
                    break
                changed = True
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over counts of sizes; (times, sizes) of the sequences.

    Items of one size go to the fullest sequences with room; equal sequences are kept as one entry
    with a count. Of all the entries that a size goes into, only the last may be split in three, so
    there are at most two more entries for each size: 2 * capacity + 1 at most, however many the items.
    """
    entries: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []

    def add(room: int, times: int, sizes: list[int]) -> None:
        if times:
            if room not in entries:
                bisect.insort(rooms, room)
            entries.setdefault(room, []).append((times, sizes))

    for size in sorted(count, reverse=True):
        c = count[size]
        while c:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                room, times, sizes = capacity, c, []
            else:
                room = rooms[k]
                times, sizes = entries[room].pop()
                if not entries[room]:
                    del entries[room], rooms[k]
            m = room // size
            full = min(times, c // m)
            rest = min(c - full * m, m) if full < times else 0
            c -= full * m + rest
            add(room - m * size, full, sizes + [size] * m)
            add(room - rest * size, int(rest > 0), sizes + [size] * rest)
            if room < capacity:
                add(room, times - full - (rest > 0), sizes)
    return [e for room in rooms for e in entries[room]]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, sizes) of all sequences: the fixed sets, then best fit over the shrunken rest."""
    fixed, left = reduce_by_dominance(count, capacity)
    return fixed + best_fit(left, capacity)


def slots(sequences: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset): where the items of a length go by rank."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for times, sizes in sequences:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            m, a = sizes.count(size), taken.get(size, 0)
            taken[size] = a + m * times
            out.append((size, a, a + m * times, base, m, offset))
            offset += m * size
        base += times
    return out


def pack(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).
    Null or empty text is the end token alone. Only documents over the capacity are cut. Each input
    row is packed, repeated rows and null ids too; an empty table gives no rows; other columns are
    not read.

    Tokens are counted once, in Arrow batches, and the pieces written to the shared folder without
    their ids unless asked for. The driver sees only how many pieces have each length (at most
    ``capacity`` numbers) and plans over those. A piece's place follows from its length and its rank
    among that length: ranks are counted inside each task and shifted by a table of (task, length)
    counts, so no length, however common, meets in one task.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(
        lean(_pieces(tokenizer, capacity, end_id, with_ids), tokenizer), schema + (", ids array<int>" if with_ids else "")
    )
    pieces = materialize(pieces, "pieces")
    runs = pieces.groupBy("length", "part").agg(F.max("local_rank").alias("last"))
    runs = materialize(runs.withColumn("n", F.col("last") + 1).drop("last"), "runs")
    count = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(plan(count, capacity))
    # each fixed set uses up a size, and k distinct sizes fill k * (k + 1) / 2 at least: 44 of them in 1,024 tokens, so there
    # are at most 3 * capacity + 44 * (2 * capacity + 1) rows, and the driver already holds them
    # as Arrow: rows of Python objects would go through more workers
    cols = [pa.array(c, pa.int64()) for c in zip(*(rows or [(0,) * 6]))]
    places = spark.createDataFrame(pa.Table.from_arrays(cols, ["len", "a", "b", "base", "m", "off"]))
    before = F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)")
    shift = runs.select("length", "part", F.coalesce(before, F.lit(0)).alias("shift"))
    # a row for every task and length grows with the input, so it is never broadcast; no key has more rows than its task
    ranked = pieces.join(shift.hint("merge"), ["length", "part"]).withColumn("rank", F.col("shift") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(places), F.expr("length = len and rank >= a and rank < b"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("base + (rank - a) div m").alias("sequence_id"),
        F.expr("off + (rank - a) % m * length").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from ``pack(..., with_ids=True)``; a sequence is bounded by the capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["ids"])).alias("ids"))
