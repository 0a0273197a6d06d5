"""What the operators of this package share: reading tables, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelog.session import reach_workers

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; any path that Spark's readers open will do."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a folder of our own only where it is unset."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="pagelog-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder. They cut the lineage: after a lost executor only the
    tasks behind a table are run again. drop() removes what later steps don't read; the rest goes
    when the interpreter ends."""

    def __init__(self, spark: SparkSession, label: str):
        reach_workers(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/pagelog-{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        delete_path(self.spark, f"{self.root}/{name}")

    def _close(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended; a cluster's own cleaning of the folder remains
            pass


def give_back() -> None:
    """Returns a task's freed memory to the system, so that workers that wait for the next one stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_iterators(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; what the function holds is given back when its task ends."""
    reach_workers(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, held: list | None = None) -> DataFrame:
    """mapInArrow by a function of one batch. held: what it keeps from batch to batch, emptied at the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        if held:
            held.clear()

    return map_iterators(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input never clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Bits of a map that keeps rows nobody wants off a shuffle: 2 MB, however many hashes are wanted. Two bits stand for a hash.
FILTER_BITS = 24


def bit_map(df: DataFrame, column: str) -> np.ndarray:
    """Two parts of each 64-bit hash of a column as bits of a map of fixed size; at most 2**18 numbers come to the driver."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    bits = df.select(F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftright(column, FILTER_BITS).bitwiseAND(mask))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).collect()
    found = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    for r in words:
        found[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return found.astype("<u8").view(np.uint8)


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For unsigned hashes whether each may be in the map; those that were put in always are."""
    low = np.uint64((1 << FILTER_BITS) - 1)

    def has(bit: np.ndarray) -> np.ndarray:
        return bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1

    return has(hashes & low) & has(hashes >> np.uint64(FILTER_BITS) & low)
