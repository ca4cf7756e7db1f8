"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmloom.session import new_dir, ship_package
from filmloom.sources.folders import remove

BATCH_BYTES = 8 << 20
PORTION_BYTES = 1 << 20


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Give the Python workers this package, and keep the batches that go to them small unless the session sets their size.

    Texts are long: ten thousand of them, Spark's default, would be tens of MB in each direction and task.
    """
    ship_package(spark)
    if spark.conf.get(_BATCH_ROWS, None) is None:
        spark.conf.set(_BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in a session that is ready for these operators."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns cannot clash; a null text is empty."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keeping_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage over documents that never meets its own column names: others than doc_id and text get plain names for its
    duration, and all come back under their own, dots and helpers' names included."""
    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        ready(docs.sparkSession)
        plain = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
        return stage(docs.toDF(*plain), *args, **kwargs).toDF(*docs.columns)

    return run


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def saved(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Written once to the shared scratch folder and read back: cuts lineage, fixes row ids, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Give the disk of a `saved` table back once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, so that results of long texts stay small in memory."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


def portions(batch: pa.RecordBatch, limit: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes, since Spark holds a whole batch outside its heap, by task."""
    size = pa.Table.from_batches([batch]).nbytes
    step = max(1, batch.num_rows * limit // max(1, size))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def fresh_name(label: str) -> str:
    """A name that no other run uses."""
    return f"{label}-{uuid.uuid4().hex}"


class Memory(dict):
    """Remembers results of a function for short keys. When it is full, it starts anew and keeps the last filling."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_held: dict[str, object] = {}


def _give_back() -> None:
    """Return freed memory to the system where the C library can (glibc); elsewhere it stays with the process."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Drop what earlier steps kept in this Python worker, for a step that keeps nothing between tasks."""
    if _held:
        _held.clear()
        gc.collect()
    _give_back()


def worker_state(name: str, make: Callable):
    """What a Python worker keeps between tasks: the state of one name alone, so that states of several steps never add up."""
    if name not in _held:
        let_go()
        _held[name] = make()
    return _held[name]
