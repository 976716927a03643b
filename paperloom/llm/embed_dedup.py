"""Near-duplicate vectors by counting collisions over many sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize
from .components import connected_components

COSINE = 0.98
#: The chance that a pair just at the cosine passes the count.
RECALL = 0.9995
#: Width of a cell's side, and half-width of the window round each query.
SIDE, HALF = 1.0, 0.45
#: Lines on which a pair must collide.
COUNT = 2
#: Rows of other directions that a query is to meet in a window, about; the depth of cells follows from it and the largest label.
MEET = 2
SEED = 20240229
#: Candidate pairs whose vectors are multiplied at once.
TOGETHER = 4096


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def collision(spread: float, depth: int) -> float:
    """Chance that two unit vectors at distance ``spread`` share a cell of ``depth`` sides and a window."""
    side = SIDE / spread
    # chance that a random grid of that side does not part a normal difference
    cell = 2 * _normal_cdf(side) - 1 - 2 / (side * math.sqrt(2 * math.pi)) * (1 - math.exp(-side * side / 2))
    return cell**depth * (2 * _normal_cdf(HALF / spread) - 1)


def lines_for(chance: float, recall: float = RECALL) -> int:
    """The least number of lines of which a pair with that chance on each meets on ``COUNT`` with probability ``recall``."""
    n = COUNT
    while sum(math.comb(n, k) * chance**k * (1 - chance) ** (n - k) for k in range(COUNT)) > 1 - recall:
        n += 1
    return n


def plan(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """Sides of a cell, so that ``rows`` rows of other directions leave about ``MEET`` in a window, and how many lines that takes.

    Each further side divides strangers by nearly four and calls for a fifth more lines, so the work for a
    row grows with about the eighth root of the rows.
    """
    near, far, depth = math.sqrt(2 - 2 * cosine), math.sqrt(2), 0
    while rows * collision(far, depth) > MEET:
        depth += 1
    return depth, lines_for(collision(near, depth))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length, each divided by its largest component: squares of very large or small
    ones would leave the range of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        x = flat[start[own][:, None] + np.arange(n)]
        yield own, x / np.abs(x).max(1, keepdims=True)


def _codes(depth: int, lines: int):
    """For each vector and line: the cell (of its label, line and length) and the place along the sorted line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(k, TOGETHER)
                ids, labels = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for own, x in _matrix(b.column(2)):
                    size = x.shape[1]
                    x = x / np.sqrt((x * x).sum(1, keepdims=True))
                    if size not in planes:
                        rng = np.random.default_rng([SEED, size])
                        a = rng.standard_normal((size, lines * (depth + 1)))
                        planes[size] = a, rng.random(lines * depth), rng.integers(1, 1 << 62, lines * depth) | 1
                    a, shift, mix = planes[size]
                    y = (x @ a).reshape(len(own), lines, depth + 1)
                    grid = np.floor(y[:, :, 1:] / SIDE + shift.reshape(1, lines, depth)).astype(np.int64)
                    cell = (grid * mix.reshape(1, lines, depth)).sum(2) + np.arange(lines) * 0x9E3779B97F4A7C1 + size
                    cell += (labels[own].astype(np.int64) * 0x2545F4914F6CDD1D)[:, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.ravel()), pa.array(y[:, :, 0].ravel()), pa.array(np.repeat(ids[own], lines))], ["cell", "place", "id"]
                    )

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted along each line: every query with those up to ``HALF`` behind it, as (u, v)."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        old = 0 if kept is None else len(kept[0])
        cell, place, ids = cols if kept is None else [np.concatenate(p) for p in zip(kept, cols)]
        n = len(ids)
        at = np.arange(n - 1)
        for d in range(1, n):
            at = at[at < n - d]
            at = at[(cell[at] == cell[at + d]) & (place[at + d] - place[at] <= HALF)]  # none further off where this one is not
            if not len(at):
                break
            a = at[at + d >= old]  # pairs whose later row is new
            u, v = np.minimum(ids[a], ids[a + d]), np.maximum(ids[a], ids[a + d])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        live = (cell == cell[-1]) & (place >= place[-1] - HALF)
        kept = [c[live] for c in (cell, place, ids)]


def _cosines(least: float):
    """Exact cosines of the candidate pairs (u, nu, x, v, nv, y), in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                b = batch.slice(k, TOGETHER)
                cosine = np.full(b.num_rows, -1.0)
                other = {x.shape[1]: (own, x) for own, x in _matrix(b.column("y"))}
                for own, x in _matrix(b.column("x")):
                    if x.shape[1] in other:
                        at, y = other[x.shape[1]]
                        both, i, j = np.intersect1d(own, at, assume_unique=True, return_indices=True)
                        x, y = x[i], y[j]
                        cosine[both] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield b.select(["u", "nu", "v", "nv"]).filter(pa.array(cosine >= least, pa.bool_()))

    return run


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``.
    A vector that is null, empty or zero, or holds a null or non-finite component, or has a null
    label or id, links with nothing. Equal vectors of a label are one point with a count, so
    copies cost nothing; a repeated row counts as another vector. Ties of ids fall together in one component. An empty
    table gives no rows.

    Each point lies on random lines. A line is sorted inside cells of a random grid over further projections; the
    grid's depth follows from the size of the largest label, so that a window holds a like number of strangers at any size, and
    the number of lines from the depth. Every query counts, per pair, the lines on which the other lies in the window round it;
    pairs that meet on ``COUNT`` lines, which ``RECALL`` of pairs just at the cosine do, are verified exactly.
    """
    raw = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x")
    )
    if dict(raw.dtypes)["x"] not in ("array<float>", "array<double>"):
        raw = raw.withColumn("x", F.col("x").cast("array<double>"))
    bound_batches(vectors.sparkSession)
    fine = F.expr(
        "id is not null and label is not null and size(x) > 0 and exists(x, c -> c <> 0) "
        "and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity'))"
    )
    own = raw.withColumn("x", F.when(F.coalesce(fine, F.lit(False)), F.col("x")))
    own = own.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(SEED), "x")})  # together they stand for the vector
    points = own.where("x is not null").groupBy("label", "h1", "h2", "x").agg(F.min("id").alias("point"), F.count("*").alias("n"))
    # vec_ids may repeat, so points have a number of their own, fixed once written
    points = materialize(points.withColumn("node", F.monotonically_increasing_id()), "points")
    largest = points.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    depth, n_lines = plan(largest, cosine)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = points.select("node", "label", "x").mapInArrow(_codes(depth, n_lines), "cell long, place double, id long")
    sorted_lines = lines.repartition(parts, "cell").sortWithinPartitions("cell", "place")
    counted = sorted_lines.mapInArrow(_windows, "u long, v long").groupBy("u", "v").count().where(f"count >= {COUNT}")
    side = lambda a, n, x, l: points.select(F.col("node").alias(a), F.col("n").alias(n), F.col("x").alias(x), F.col("label").alias(l))
    pairs = counted.select("u", "v").join(side("u", "nu", "x", "lu"), "u").join(side("v", "nv", "y", "lv"), "v").where("lu = lv")
    found = materialize(
        pairs.select("u", "nu", "x", "v", "nv", "y").mapInArrow(_cosines(cosine), "u long, nu long, v long, nv long"), "pairs"
    )
    both = found.select(F.col("u").alias("node"), F.col("nv").alias("m")).unionByName(found.select(F.col("v").alias("node"), F.col("nu").alias("m")))
    links = both.groupBy("node").agg(F.sum("m").alias("m"))
    joined = points.select("node", "point").join(connected_components(found.select("u", "v")), "node", "left")
    linked = materialize(links.select("node").join(joined, "node").select("node", "point", F.coalesce("component", "node").alias("root")), "linked")
    least = linked.groupBy("root").agg(F.min("point").alias("component"))
    parent = linked.select("node", "root").join(least, "root").select("node", "component")
    placed = points.join(links, "node", "left").join(parent, "node", "left").select(
        F.col("label").alias("own_label"), F.col("h1").alias("own_h1"), F.col("h2").alias("own_h2"),
        (F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"),
    )
    keys = own.select("id", F.when(F.col("x").isNotNull(), F.col("label")).alias("label"), "h1", "h2")
    joined = keys.join(placed, F.expr("label = own_label and h1 = own_h1 and h2 = own_h2"), "left")
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.expr("vec_id <=> component_id"))
