"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

#: A task's union-find holds at most so many nodes before it is written out and begun anew.
FOREST_NODES = 500_000
#: Up to so many edges left by the tasks are joined by one task, which can hold their nodes.
LAST_EDGES = FOREST_NODES // 2


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest (node, smallest node) of what each task reads."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"]
        )

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_NODES:
            yield out()
            parent.clear()
    yield out()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (smallest node reachable) for every node of ``edges``
    that is not the smallest of its own component.

    ``edges`` holds two long columns; self-loops, repeats and nulls are dropped, no edges give no
    rows. Each task first reduces its edges to a forest, so dense groups shrink before any shuffle.
    What is left goes through one more forest where one task can hold it, which spares the driver the plans of all rounds; else
    large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond") run to a fixed point, each written to the shared folder. A node with very many edges
    is a skewed join key, which adaptive execution splits.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    stars = materialize(pairs.mapInArrow(lean(forest), "u long, v long").distinct(), "edges")
    if stars.count() <= LAST_EDGES:
        last = materialize(stars.coalesce(1).mapInArrow(lean(forest), "u long, v long"), "components")
        return last.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now[0] == 0 or now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        stars = materialize(_small_star(_large_star(stars)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
