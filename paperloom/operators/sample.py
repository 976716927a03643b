"""Seeded stratified samples and review queues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SEED, TARGET = 20260925, 1000
FIELDS = ("ai", "math", "physics", "qbio", "med", "econ")
LEAST_WEIGHT = 0.05


def allocate(sizes: dict, quota: int) -> dict:
    """One at a time round the sorted keys while a group has room, until the quota is spent."""
    out, left = dict.fromkeys(sorted(sizes), 0), quota
    while left > 0 and any(out[k] < sizes[k] for k in out):
        level = min(sizes[k] - out[k] for k in out if out[k] < sizes[k])
        free = [k for k in out if out[k] < sizes[k]]
        step = min(level, left // len(free))
        if step:
            for k in free:
                out[k] += step
            left -= step * len(free)
        else:
            for k in free[:left]:
                out[k] += 1
            left = 0
    return out


def mulberry32(seed: int):
    """The generator that replays a serial sample."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        v = (state ^ state >> 15) * (1 | state) & 0xFFFFFFFF
        v = (v + ((v ^ v >> 7) * (61 | v) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ v
        return ((v ^ v >> 14) & 0xFFFFFFFF) / 4294967296

    return draw


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of seed and key, the same on any engine and partitioning."""
    own = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))
    return (F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296


def weight(confidence: Column) -> Column:
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - F.coalesce(confidence, F.lit(0.0)))


def allocated(rows: DataFrame, strata: Sequence[str], quota: int) -> DataFrame:
    """Strata with their quota, nested: the quota is shared over the first column, each share over the next, and so on.

    Only counts by stratum reach the driver.
    """
    sizes = [(tuple(r[c] for c in strata), r["count"]) for r in rows.groupBy(*strata).count().collect()]

    def share(own: list, level: int, n: int) -> list[tuple]:
        if level == len(strata):
            return [(*k, n) for k, _ in own]
        groups: dict = {}
        for k, c in own:
            groups.setdefault(k[level], []).append((k, c))
        quotas = allocate({k: sum(c for _, c in g) for k, g in groups.items()}, n)
        return [x for k, m in quotas.items() for x in share(groups[k], level + 1, m)]

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in strata) + ", quota long"
    return rows.sparkSession.createDataFrame(share(sizes, 0, quota) if sizes else [], schema)


def stratified(rows: DataFrame, strata: Sequence[str], quota: int, key: Sequence[str], seed: int = SEED, confidence: str | None = None) -> DataFrame:
    """A weighted sample without replacement in every stratum: the greatest u^(1/w), then the key.

    The greatest share is a constant, so Spark keeps only that many rows of a stratum before the shuffle.
    """
    shares = allocated(rows, strata, quota)
    most = shares.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    w = weight(F.col(confidence)) if confidence else F.lit(1.0)
    draw = F.pow(uniform(seed, *(F.col(k) for k in key)), 1 / w)
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(F.col("__u").desc(), *key))
    top = rows.withColumn("__u", draw).withColumn("__k", rank).where(F.col("__k") <= most)
    return top.join(shares, list(strata)).where("__k <= quota").drop("__u", "__k", "quota")


def replay(units: pd.DataFrame, target: int = TARGET, seed: int = SEED) -> pd.DataFrame:
    """The serial form: one generator through fields, sources and types in fixed order; strata taken whole draw nothing.

    For label sets of a size that one machine holds.
    """
    draw, chosen = mulberry32(seed), []
    pool = units[units.field.isin(FIELDS)].copy()
    pool["kind"] = [("display" if t == "display" else "inline") + (":eq" if e else ":plain") for t, e in zip(pool.type, pool.equationNumber)]
    per_field = {f: len(pool[pool.field == f]) for f in FIELDS if (pool.field == f).any()}
    order = {f: k for k, f in enumerate(FIELDS)}
    left, fields = target, dict.fromkeys(per_field, 0)
    while left > 0 and any(fields[f] < per_field[f] for f in fields):
        for f in sorted(fields):
            if left > 0 and fields[f] < per_field[f]:
                fields[f], left = fields[f] + 1, left - 1
    for f in sorted(fields, key=order.get):
        mine = pool[pool.field == f]
        for s, n in allocate(mine.groupby("sourceType").size().to_dict(), fields[f]).items():
            own = mine[mine.sourceType == s]
            for kind, m in allocate(own.groupby("kind").size().to_dict(), n).items():
                rows = own[own.kind == kind].sort_values(["paperId", "page", "unitId"])
                if len(rows) > m:
                    keys = [max(draw(), 1e-12) ** (1 / max(LEAST_WEIGHT, 1 - (c or 0))) for c in rows.confidence]
                    rows = rows.assign(u=keys).sort_values(["u", "paperId", "page", "unitId"], ascending=[False, True, True, True]).head(m).drop(columns="u")
                chosen.append(rows)
    return pd.concat(chosen) if chosen else pool.head(0)


#: Slices of a group over which ranks are carried.
SLICES = 4096


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, nulls_last: bool = False) -> DataFrame:
    """``name``: the row's number inside its keys by ``order``, from 1.

    Where the first order column is a number, a group is cut at equal steps between its least and greatest value and counts of slices are
    carried over, so one task sorts a slice and not the group. The steps follow from the values alone: the plan reads the rows twice, and
    approximate quantiles may differ between the two. Nulls come first unless ``nulls_last``.
    """
    first = order[0]
    by = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c in order]
    if not isinstance(rows.schema[first].dataType, NumericType):
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    value = F.col(first).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    ends = ends.select(*(F.col(k).alias(f"__{k}") for k in keys), "__lo", "__hi")
    # no number where a group has one value or ends in NaN or infinity: its numbers are one slice
    share = F.try_divide(value - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    step = F.when(share.isNull() | F.isnan(share), 0).otherwise(F.floor(share * SLICES).cast("int"))
    own = rows.join(ends, same).withColumn("__slice", F.when(F.col(first).isNull(), SLICES + 1 if nulls_last else -1).otherwise(step))
    own = own.drop("__lo", "__hi", *(f"__{k}" for k in keys))
    counts = own.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*by))
    placed = own.withColumn("__in", inside).join(carried, same & (F.col("__slice") == F.col("__s")))
    return placed.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__before", "__in", "__slice", "__s", *(f"__{k}" for k in keys))


def review_queue(units: DataFrame, outer: str = "field", inner: str = "paperId", order: Sequence[str] = ("confidence", "page", "unitId")) -> DataFrame:
    """Interleaved round the outer groups, inside them round the inner groups, inside those by confidence: a position for each row."""
    own = ranked(units, [outer, inner], order, "__a", nulls_last=True)
    # a round holds one row of each inner group at most, so rounds are counted and only inside them rows are ranked
    rounds = own.groupBy(outer, "__a").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(outer).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    rounds = rounds.select(F.col(outer).alias("__o"), F.col("__a").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(outer, "__a").orderBy(F.col(inner).asc_nulls_last()))
    own = own.join(rounds, F.col(outer).eqNullSafe(F.col("__o")) & (F.col("__a") == F.col("__r"))).withColumn("__b", place.cast("int"))
    return own.withColumn("queue", F.struct("__b", F.col(outer))).drop("__a", "__b", "__before", "__o", "__r")
