"""Structured Streaming forms of the event log and the change feed.

State stays small: each batch is merged into a snapshot by ``foreachBatch``, keyed guards run as stateful pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events, store


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The change log as a stream of appended files; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).parquet(path)


def _swap(df: DataFrame, root: str, batch: int) -> None:
    """A new snapshot beside the last; a batch that runs again writes the same folder."""
    df.write.mode("overwrite").parquet(f"{root}/v={batch}")


def latest(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    """The last snapshot, of batches below ``before``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{root}/v={max(done)}") if done else spark.createDataFrame([], schema)


def apply_changes(changes: DataFrame, root: str, key: list[str], schema, checkpoint: str):
    """A query that merges remote puts into the snapshot at ``root``; deletes are never applied."""

    def merge(batch: DataFrame, n: int) -> None:
        old = latest(batch.sparkSession, root, schema, n)
        _swap(store.apply_changes(old, batch, key), root, n)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def keep_log(log: DataFrame, root: str, checkpoint: str, clock: Callable[[], int], secrets: list[str] = ()):
    """A query that cleans events and keeps them by age and bytes at every flush, by the clock and not by event time."""

    def flush(batch: DataFrame, n: int) -> None:
        own = events.clean(batch, secrets)
        both = latest(batch.sparkSession, root, own.schema, n).unionByName(own)
        size = F.octet_length(F.to_json(F.struct(*own.columns)))
        _swap(events.retain(both, clock(), size), root, n)

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)


def changed_lines(captions: DataFrame) -> DataFrame:
    """Captions (tab, t, text) of a stream, only where a tab's line changes."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for t, line in sorted(zip(pdf.t, pdf.text)):
                if line != last:
                    out.append((key[0], t, line))
                    last = line
        state.update((last,))
        yield pd.DataFrame(out, columns=["tab", "t", "text"])

    return captions.groupBy("tab").applyInPandasWithState(run, "tab long, t long, text string", "text string", "append", GroupStateTimeout.NoTimeout)


def guarded_commits(writes: DataFrame) -> DataFrame:
    """Outcome of each write of a stream under the commit guards, with the state of its key kept."""
    fields = ["key", "value", "verified", "epoch", "writer", "serial", "at"]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        row, chain = json.loads(state.get[0]) if state.exists else (None, [])
        out = []
        for pdf in batches:
            for w in pdf.sort_values("seq").to_dict("records"):
                new = {f: (w[f].item() if hasattr(w[f], "item") else w[f]) for f in fields}
                row, chain, how = events.commit(row, chain, new)
                out.append((key[0], w["seq"], how, row["value"]))
        state.update((json.dumps([row, chain]),))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "value"])

    return writes.groupBy("key").applyInPandasWithState(run, "key string, seq long, outcome string, value string", "state string", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; late ones beyond the watermark are dropped. An addition, not part of the event log."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").count()
