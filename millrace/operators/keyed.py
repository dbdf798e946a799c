"""Per-key order: sequences, sessions, cohorts, poison, lanes and ordered folds."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions import errors, scalars
from millrace.sources import readers


def sequence(df: DataFrame, key: str, pos: str = "pos", name: str = "seq", hot: bool = False) -> DataFrame:
    """Dense 0-based number of each row among its key's. With hot, for keys that hold more rows than a task
    should, rows are numbered over all keys by ranges, and each key's first number is taken off."""
    if not hot:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1).cast("long"))
    numbered = readers.indexed(df.withColumnRenamed("pos", "__pos") if "pos" in df.columns else df, key, "__pos" if pos == "pos" else pos).withColumnRenamed("pos", "__at")
    first = numbered.groupBy(F.col(key).alias("__key")).agg(F.min("__at").alias("__first"))
    out = numbered.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, (F.col("__at") - F.col("__first")).cast("long"))
    return out.drop("__key", "__first", "__at").withColumnRenamed("__pos", "pos")


def lanes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of a key in one lane and one partition."""
    return df.withColumn("lane", scalars.lane(F.col(key), n)).repartition(n, "lane")


def sessions(df: DataFrame, key: str, ts: str, idle: str, pos: str = "pos") -> DataFrame:
    """session: 0-based; a key's lane retires after ``idle`` without a row, and its state with it."""
    w = Window.partitionBy(key).orderBy(ts, pos)
    fresh = F.coalesce((F.col(ts) - F.lag(ts).over(w)) > F.expr(f"INTERVAL {idle}"), F.lit(False))
    return df.withColumn("__new", fresh.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def cohorts(df: DataFrame, key: str, submit: str, exit_: str, pos: str = "pos") -> DataFrame:
    """cohort: 0-based; a key's state starts anew when nothing of it was in flight as the row came."""
    w = Window.partitionBy(key).orderBy(submit, pos)
    latest = F.max(exit_).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(submit) >= latest, F.lit(False)).cast("int")
    return df.withColumn("__new", fresh).withColumn("cohort", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def poison(df: DataFrame, *keys: str, seq: str = "seq", own: str = "own_err") -> DataFrame:
    """err: a key's rows after its first failing one get key_failed; rows before it, and it, keep their own."""
    first = df.filter(F.col(own).isNotNull()).groupBy(*keys).agg(F.min(seq).alias("__first"))
    late = F.coalesce(F.col(seq) > F.col("__first"), F.lit(False))
    own_err = errors.when(F.col(own).isNotNull(), "user", F.col(own))
    return df.join(first, list(keys), "left").withColumn("err", F.when(late, errors.error("key_failed", "an earlier one of this key failed")).otherwise(own_err)).drop("__first")


def torn_down(df: DataFrame, panics: Column, pos: str = "pos") -> DataFrame:
    """err: rows from the first panic on are torn down."""
    first = df.agg(F.min(F.when(panics, F.col(pos))).alias("__first"))
    late = F.coalesce(F.col(pos) >= F.col("__first"), F.lit(False))
    return df.crossJoin(F.broadcast(first)).withColumn("err", errors.when(late, "torn_down", "a panic ended the run")).drop("__first")  # one row


def running(df: DataFrame, key: str, value: Column, pos: str = "pos", name: str = "state") -> DataFrame:
    """A key's running sum in order."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def fold(df: DataFrame, key: str, pos: str, step: Callable, start: Callable, schema: str) -> DataFrame:
    """An opaque ordered fold: step(state, row) gives (state, outputs). Rows stream through in order, so that a
    task holds one Arrow batch and one state, however many rows a key has."""

    row = namedtuple("row", df.columns)

    def run(batches):
        last, state = object(), None
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # plain values: a null stays one
                now = row(*values)
                k = getattr(now, key)
                if k != last:
                    last, state = k, start()
                state, got = step(state, now)
                out += got
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names, kinds = arrow.names, [f.type for f in arrow]
    return df.repartition(key).sortWithinPartitions(key, pos).mapInArrow(run, schema)


def admission(df: DataFrame, key: str, submit: str, work: str, depth: int, pos: str = "pos") -> DataFrame:
    """start, end of each row where at most ``depth`` of a key are in flight (0: any number): a row enters
    when it is submitted and the one ``depth`` before it has left."""
    if depth < 0:
        raise ValueError("depth must not be negative")

    def step(ends, row):
        at = getattr(row, submit)
        begin = max(at, ends[0]) if depth and len(ends) == depth else at
        end = begin + getattr(row, work)
        return (sorted([*ends, end])[-depth:] if depth else []), [(getattr(row, key), getattr(row, pos), begin, end)]

    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {pos} {kinds[pos]}, begin {kinds[submit]}, finish {kinds[submit]}"
    return fold(df.select(key, pos, submit, work), key, pos, step, list, schema)


def config(has_key: bool, stages: int, stop_on_err: bool = False, depth: int | None = None) -> int:
    """The admission depth of these options; raises where they don't fit together."""
    if has_key != (stages > 0):
        raise ValueError("a key and ordered stages come together")
    if not has_key and (stop_on_err or depth is not None):
        raise ValueError("stopping a key and admission depth need a key")
    if stages > 64:
        raise ValueError("at most 64 stages can be ordered")
    if depth is not None and depth < 0:
        raise ValueError("depth must not be negative")
    return 4 if depth is None else depth


def singleflight(df: DataFrame, key: str, compute: Callable) -> DataFrame:
    """compute(distinct keys) once a key, joined back to every row."""
    return df.join(compute(df.select(key).distinct()), key)
