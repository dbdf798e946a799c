"""What the operators of this subpackage share: reading tables, tokens, and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
TOKEN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, no executor's loss undoes it,
    and the planner knows its size when it chooses a join."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(conf).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under this package's names, so that no other column of the input can clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(source: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of at most that many rows, so that Python objects of one slice only are alive at a time."""
    for batch in source:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Bounded:
    """What a task remembers of words, in ``of``, and nothing after it: ``room(words)`` makes room for new ones,
    emptying all when their bytes, with ``each`` for every entry, would pass ``most``."""

    def __init__(self, each: int = 200, most: int = 64 << 20):
        self.of: dict = {}  # a plain one: sets are compared with it by its own lookups
        self.each, self.most, self.size = each, most, 0

    def room(self, words) -> bool:
        """Whether all had to go."""
        more = sum(map(len, words)) * 2 + len(words) * self.each
        gone = bool(self.of) and self.size + more > self.most
        if gone:
            self.of.clear()
            self.size = 0
        self.size += more
        return gone


def frugal(run):
    """run, a task's work on a stream of batches, giving back to the system what it held: Spark uses a worker
    again, and memory that the next task can't see would add up."""

    def work(source):
        try:
            yield from run(source)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return work


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
