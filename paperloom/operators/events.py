"""Event logs: clean-up, retention, eviction, rates, commit guards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redact
from ..functions.text import text

RETENTION_MS, FUTURE_MS, BYTES = 7 * 24 * 3600 * 1000, 60_000, 2 * 1024 * 1024
DOC_LIMIT, STORE_BYTES, CHAIN = 2000, 50 * 1024 * 1024, 8


def clean(events: DataFrame, secrets: list[str] = ()) -> DataFrame:
    """Only known fields, messages scrubbed, codes and models held to their form."""
    name = lambda c, p: F.when(text(c).rlike(p), F.col(c))
    known = [c for c in ("page", "count", "ms", "ok", "mode") if c in events.columns]
    return events.select(
        "t", name("type", r"^[A-Za-z0-9._-]{1,40}$").alias("type"), name("code", r"^[A-Za-z0-9._-]{1,40}$").alias("code"),
        redact.scrub_message("msg", secrets).alias("msg"), F.substring(name("model", r"^[A-Za-z0-9._:/-]+$"), 1, 40).alias("model"), *known,
    ).where("type is not null and t is not null")


#: Width of the time slices over which running sums are carried.
SLICE_MS = 3_600_000


def running_total(rows: DataFrame, at: str, value: str, tie: str | None = None, keys: list[str] = (), width: int = SLICE_MS) -> DataFrame:
    """``__sum``: the sum of ``value`` from the newest row down to each row.

    Sums of time slices are carried over first, so only one slice of a key is ever sorted in a task.
    """
    own = rows.withColumn("__slice", F.floor(F.col(at) / width))
    sums = own.groupBy(*keys, "__slice").agg(F.sum(value).alias("__s"))
    newer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("__slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__slice", F.coalesce(F.sum("__s").over(newer), F.lit(0)).alias("__carried"))
    order = [F.col(at).desc()] + ([F.col(tie).desc()] if tie else [])
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.join(carried, [*keys, "__slice"]).withColumn("__sum", F.col("__carried") + F.sum(value).over(inside)).drop("__slice", "__carried")


def retain(events: DataFrame, now: int, size: Column, key: str | None = None, days_ms: int = RETENTION_MS, cap: int = BYTES, tie: str | None = None) -> DataFrame:
    """Events of the last days and not of the future; the oldest go until the rest, as a JSON array, fits the cap.

    Give ``key`` where a table holds many logs.
    """
    fresh = events.where(F.col("t").between(now - days_ms, now + FUTURE_MS)).withColumn("__n", size + 1)
    return running_total(fresh, "t", "__n", tie, [key] if key else []).where(F.col("__sum") + 1 <= cap).drop("__n", "__sum")


def evict(records: DataFrame, doc_limit: int = DOC_LIMIT, byte_limit: int = STORE_BYTES, doc: str = "docHash") -> DataFrame:
    """Keys to drop: a document's oldest over its limit, then the oldest of all until the bytes fit; ties by key."""
    newest = Window.partitionBy(doc).orderBy(F.col("decidedAt").desc(), F.col("key").desc())
    own = records.withColumn("__k", F.row_number().over(newest))
    kept = own.where(F.col("__k") <= doc_limit)
    late = running_total(kept, "decidedAt", "bytes", "key").where(F.col("__sum") > byte_limit)
    return own.where(F.col("__k") > doc_limit).select("key", F.lit("document").alias("reason")).unionByName(late.select("key", F.lit("bytes").alias("reason")))


def swap_rate(events: DataFrame, by: list[str] = ()) -> DataFrame:
    own = events.where("type = 'mm.page.ok' and pageSwap is not null").groupBy(*by)
    return own.agg(F.count("*").alias("swaps"), F.count_if("pageSwap").alias("pageSwaps")).withColumn("rate", F.col("pageSwaps") / F.nullif("swaps", F.lit(0)))


def gap_fill(events: DataFrame, by: list[str] = ()) -> DataFrame:
    """Filled over all gaps; null when there were none."""
    n = lambda c: F.sum(F.greatest(F.coalesce(F.floor(c), F.lit(0)), F.lit(0)))
    own = events.where("type = 'mm.page.reconcile'").groupBy(*by).agg(n("gapsIn").alias("gapsIn"), n("gapsFilled").alias("gapsFilled"))
    return own.withColumn("rate", F.col("gapsFilled") / F.nullif("gapsIn", F.lit(0)))


def changed_lines(captions: DataFrame, key: str = "tab") -> DataFrame:
    """Captions only where the line differs from the one before."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy("t"))
    return captions.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("text"))).drop("__b")


STATE = "key string, value string, verified boolean, epoch long, writer string, serial long, at long"


def commit(row: dict | None, chain: list[dict], new: dict) -> tuple[dict, list[dict], str]:
    """One guarded write: (row, chain of replaced verified rows, outcome)."""
    if row:
        if row["verified"] and not new["verified"]:
            return row, chain, "downgrade"
        if new["epoch"] < row["epoch"]:
            return row, chain, "epoch"
        if row["verified"] and new["verified"]:
            if new["writer"] == row["writer"] and new["serial"] < row["serial"]:
                return row, chain, "serial"
            if new["at"] < row["at"]:
                return row, chain, "late"
            if len(chain) >= CHAIN:
                return row, chain, "full"
            chain = [row, *chain]
    return new, chain, "kept"


def rollback(row: dict | None, chain: list[dict], writer: str) -> tuple[dict | None, list[dict]]:
    """The current writer's rollback restores the chain's head; another's removes its entry."""
    if row and row["writer"] == writer:
        return (chain[0], chain[1:]) if chain else (None, [])
    return row, [c for c in chain if c["writer"] != writer]


def fold_commits(writes: DataFrame) -> DataFrame:
    """Final row, chain length and refusals of each key, writes taken by ``seq``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, chain, refused = None, [], 0
        for w in pdf.sort_values("seq").to_dict("records"):
            row, chain, how = commit(row, chain, w)
            refused += how != "kept"
        return pd.DataFrame([(row["key"], row["value"], row["verified"], row["epoch"], len(chain), refused)], columns=["key", "value", "verified", "epoch", "chain", "refused"])

    return writes.groupBy("key").applyInPandas(run, "key string, value string, verified boolean, epoch long, chain int, refused int")


def neighbours(rows: DataFrame, focus: DataFrame, n: int, key: str = "doc") -> DataFrame:
    """The n rows closest to a focus (key, focus ord), the one before first of a tie, in order; without a focus the first n."""
    own = rows.join(focus.select(key, F.col("ord").alias("__f")), key, "left")
    far = F.abs(F.col("ord") - F.col("__f"))
    w = Window.partitionBy(key).orderBy(far.asc_nulls_last(), "ord")
    pick = own.where(F.col("__f").isNull() | (F.col("ord") != F.col("__f"))).withColumn("__k", F.row_number().over(w))
    return pick.where(F.col("__k") <= n).drop("__k", "__f")


def history(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each turn with the texts of the turns before it: the sum of all prompts of a conversation, which grows with its square."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(w))
