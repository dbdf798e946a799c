"""Value-or-error maps over positioned rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import errors


def item(df: DataFrame, value: Column, error: Column | None = None) -> DataFrame:
    """v and err by native expressions: exactly one of them a row, v null where err is not."""
    err = errors.none() if error is None else error
    return df.withColumn("err", err).withColumn("v", F.when(F.col("err").isNull(), value))


def item_func(df: DataFrame, func: Callable, kind: str, column: str = "v", attempts: int = 1, permanent: type | tuple = ()) -> DataFrame:
    """v and err by an opaque Python function, called at most ``attempts`` times a row; an error of a
    permanent type is never tried again."""
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    rest = [c for c in df.columns if c != column]
    schema = df.select(*rest).limit(0).select("*", F.lit(None).cast(kind).alias("v"), errors.none().alias("err"), F.lit(0).alias("calls")).schema

    def one(x):
        for n in range(1, attempts + 1):
            try:
                return func(x), None, n
            except Exception as e:  # noqa: BLE001  every input yields one result
                failed, sure = e, bool(permanent) and isinstance(e, permanent)
                if sure:
                    break
        return None, {"kind": "user", "msg": str(failed), "permanent": sure}, n

    def run(frames):
        for f in frames:
            got = [one(x) for x in f[column]]
            yield pd.concat([f[rest].reset_index(drop=True), pd.DataFrame({"v": [g[0] for g in got], "err": [g[1] for g in got], "calls": [g[2] for g in got]})], axis=1)

    return df.mapInPandas(run, schema)


def stop_on_error(df: DataFrame, pos: str = "pos", err: str = "err") -> DataFrame:
    """Rows up to and with the first error by position."""
    first = df.agg(F.min(F.when(F.col(err).isNotNull(), F.col(pos))).alias("__first"))
    return df.crossJoin(F.broadcast(first)).filter(F.col("__first").isNull() | (F.col(pos) <= F.col("__first"))).drop("__first")  # one row


def ordered(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos)


def first_n(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """A consumer that breaks after n values."""
    return df.orderBy(pos).limit(n)


def sweep(dispatched: DataFrame, delivered: DataFrame, pos: str = "pos", cause: str = "cancelled") -> DataFrame:
    """delivered, and for every dispatched row without a result one with the cause of the cancellation."""
    lost = dispatched.join(delivered, pos, "left_anti").select(pos)
    value = F.lit(None).cast(dict(delivered.dtypes)["v"]).alias("v")
    return delivered.select(pos, "v", "err").unionByName(lost.select(pos, value, errors.error("cancelled", cause).alias("err")))


def contiguous(df: DataFrame, pos: str = "pos", *keys: str) -> DataFrame:
    """While a stream is open only the prefix without a gap is out: rows before the first missing position."""
    return df.join(turns(df, pos, *keys).withColumnsRenamed({k: f"__{k}" for k in keys}), _same(keys) & (F.col(pos) < F.col("turn"))).select(*df.columns)


def turns(df: DataFrame, pos: str = "pos", *keys: str) -> DataFrame:
    """keys, turn: the lowest position that is not there yet. Joins on positions, so that no task holds a whole stream."""
    after = df.select(*keys, (F.col(pos) + 1).alias("turn")).union(df.select(*keys).distinct().withColumn("turn", F.lit(0).cast("long")))
    there = df.select(*keys, F.col(pos).alias("turn")).distinct()
    return after.join(there, [*keys, "turn"], "left_anti").groupBy(*keys).agg(F.min("turn").alias("turn"))


def _same(keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(k) == F.col(f"__{k}")
    return out
