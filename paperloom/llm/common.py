"""Shared helpers: tables in the shared folder, and column checks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names it, else the context's
    checkpoint folder. Only a local master gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table ends the lineage: a lost executor costs no more than the
    tasks that read it. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents of fewer scan partitions than cores are dealt over all cores."""
    df = tables.read(spark, sf_dir, name)
    return tables.spread(df) if name == "documents" else df


#: Bytes of an Arrow batch sent to a Python worker, where the session leaves Spark's own bound: rows may hold whole documents.
BATCH_BYTES, SPARK_BYTES = "8m", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch, unless the session names a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, SPARK_BYTES) == SPARK_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; other columns cannot clash."""
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: Rows whose texts are held at once.
TOGETHER = 128


def slices(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


#: What a Python worker keeps from one task to the next.
_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The object of this name, made once in each Python worker; it goes when a lean task begins that does not name it."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def hand_back(*names: str) -> None:
    """Let go what is kept but for ``names``, and give freed memory back to the system, which Arrow's pool and the C library else hold."""
    for name in [x for x in _kept if x not in names]:
        del _kept[name]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *names: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow without what earlier tasks left in the worker, but for ``names``.

    Workers live on from task to task, beside the executor's heap: what each of them has once used would add up over the stages.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back(*names)
        try:
            yield from run(batches)
        finally:
            hand_back(*names)

    return own


def hold_out(id_col: str, modulus: int, remainder: int):
    """True for the rows whose crc32(id as text) leaves ``remainder``; null ids are held out."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(True))
