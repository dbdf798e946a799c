"""Sinks: side effects by partition, upserts, and loads that are published whole or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import errors

#: Database states after which no retry helps.
PERMANENT_STATES = ("25P02", "42703", "22P04", "22021", "42601", "42P01")


def is_permanent(severity: str, state: str) -> bool:
    return severity == "FATAL" or state in PERMANENT_STATES


def for_each(df: DataFrame, worker: Callable, size: int) -> None:
    """Runs worker on every row, in at most ``size`` tasks at a time; its errors are dropped."""
    if size < 1:
        raise ValueError("size must be at least 1")
    if worker is None:
        raise ValueError("a worker is needed")

    def each(rows):
        for row in rows:
            try:
                worker(row)
            except Exception:  # noqa: BLE001, S110  a sink for side effects has nobody to tell
                pass

    df.coalesce(size).foreachPartition(each)


def retry(action: Callable, attempts: int, permanent: Callable[[Exception], bool] = lambda e: False, pause: Callable[[int], float] = lambda n: min(60.0, 0.1 * 2**n)):
    """action()'s result, tried again with growing pauses; a permanent error is raised at once."""
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    for n in range(attempts):
        try:
            return action()
        except Exception as e:  # noqa: BLE001
            if permanent(e) or n + 1 == attempts:
                raise
            time.sleep(pause(n))


def reset_table(spark: SparkSession, name: str, schema: str) -> None:
    """Drops the table and makes it anew, empty; doing so twice is the same."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([], schema).write.mode("overwrite").format("parquet").saveAsTable(name)


def insert(df: DataFrame, name: str) -> None:
    """Appends by column name; columns that the table doesn't have are left out."""
    known = df.sparkSession.table(name).columns
    df.select(*known).write.mode("append").format("parquet").insertInto(name)


def write_batches(df: DataFrame, write: Callable, items: int = 100_000, attempts: int = 5, permanent: Callable[[Exception], bool] = lambda e: False) -> DataFrame:
    """Hands every block of at most ``items`` rows, a list, to write, which puts it in one transaction; what write
    raises is tried again unless permanent. block, rows, err: one row a block, with the error that remained.
    Blocks are of one partition, so a task that runs again writes its blocks again: write must be idempotent by
    block, the first argument."""
    if items < 1 or attempts < 1:
        raise ValueError("items and attempts must be at least 1")

    def put(block, rows):
        try:
            retry(lambda: write(block, rows), attempts, permanent)
            return block, len(rows), None
        except Exception as e:  # noqa: BLE001  a block's error is its result
            return block, len(rows), {"kind": "user", "msg": str(e), "permanent": permanent(e)}

    def run(frames):
        part, held, n = TaskContext.get().partitionId(), [], 0
        for f in frames:
            held += f.to_dict("records")
            while len(held) >= items:
                yield pd.DataFrame([put(f"{part}-{n}", held[:items])], columns=["block", "rows", "err"])
                held, n = held[items:], n + 1
        if held:
            yield pd.DataFrame([put(f"{part}-{n}", held)], columns=["block", "rows", "err"])

    return df.mapInPandas(run, f"block string, rows long, err {errors.SCHEMA}")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changes (key, value columns, op), one change a key: Add replaces, Delete removes."""
    kept = table.join(changes, key, "left_anti")
    return kept.unionByName(changes.filter("op = 'Add'").select(*table.columns))


def publish(df: DataFrame, target: str, commit: Callable[[DataFrame], bool]) -> bool:
    """Writes a version of its own under target and, if commit says so of what was written, makes it the one that
    ``published`` reads, by one rename of a small file over no other: readers see the old version or the new one,
    and a crash in between leaves the old one."""
    spark: SparkSession = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{target}/data-{version}")
    written = spark.read.schema(df.schema).parquet(f"{target}/data-{version}")
    if not commit(written):
        _fs(spark, target)[0].delete(_fs(spark, f"{target}/data-{version}")[1], True)
        return False
    number = max([n for n, _ in _versions(spark, target)], default=0) + 1
    fs, draft = _fs(spark, f"{target}/_draft-{version}")
    fs.create(draft, True).close()
    if not fs.rename(draft, _fs(spark, f"{target}/_v{number:012d}-{version}")[1]):
        raise OSError(f"{target} could not be published")
    return True


def published(spark: SparkSession, target: str) -> DataFrame:
    """The latest version that was published to target."""
    found = _versions(spark, target)
    if not found:
        raise ValueError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/data-{max(found)[1]}")


def _fs(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    fs, path = _fs(spark, target)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return [(int(x[2:14]), x[15:]) for x in names if x.startswith("_v")]


def fail_fast(df: DataFrame, target: str, err: str = "err") -> bool:
    """Loads all rows if none has an error: what is written is what is counted."""
    return publish(df, target, lambda written: not written.filter(F.col(err).isNotNull()).limit(1).count())


def error_budget(df: DataFrame, target: str, err: str = "err", budget: float = 0.1) -> bool:
    """Loads the rows without errors unless more than that share of records has one. Records are the rows and
    one more, as the reader counts the end of the file."""

    def holds(written: DataFrame) -> bool:
        n, bad = written.agg(F.count("*") + 1, F.count(err)).first()
        return bad / n <= budget

    return publish(df, target, holds)


def loaded(spark: SparkSession, target: str, err: str = "err") -> DataFrame:
    """The rows without errors of the latest load."""
    rows = published(spark, target)
    return rows.filter(F.col(err).isNull()).drop(err)
