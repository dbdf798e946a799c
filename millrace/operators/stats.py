"""Run and wait times, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from millrace.functions import scalars


def times(df: DataFrame, *keys: str, run: str = "run_ns", wait: str | None = None, done: Column | None = None) -> DataFrame:
    """completed, and min, avg, max of the run times of completed rows; 0 where there are none. Wait times are of
    all rows, but their average divides by the completed ones. Averages are whole nanoseconds."""
    finished = F.lit(True) if done is None else done
    n = F.count_if(finished)

    def of(column: Column, name: str) -> list[Column]:
        mean = F.when(n == 0, F.lit(0)).otherwise(scalars.quotient(F.sum(column), F.greatest(n, F.lit(1))))
        return [F.coalesce(f, F.lit(0)).cast("long").alias(f"{name}_{k}") for k, f in (("min", F.min(column)), ("avg", mean), ("max", F.max(column)))]

    out = [n.cast("long").alias("completed"), F.count("*").cast("long").alias("ingested"), *of(F.when(finished, F.col(run)), "run")]
    return df.groupBy(*keys).agg(*out, *(of(F.col(wait), "wait") if wait else []))


def in_flight(df: DataFrame, submit: str, exit_: str, width: str) -> DataFrame:
    """begin, running: how many are in flight at the end of each window. Rows are summed by window first."""
    begin = lambda c: F.window(c, width)["start"].cast("timestamp_ntz")
    steps = df.select(begin(submit).alias("begin"), F.lit(1).alias("n")).union(df.select(begin(exit_), F.lit(-1)))
    sums = steps.groupBy("begin").agg(F.sum("n").alias("n"))
    w = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)  # one row a window of time
    return sums.select("begin", F.sum("n").over(w).alias("running"))


def observed(df: DataFrame, name: str, err: str = "err"):
    """(df, observation): counts of rows and errors, taken while df is written and not by a pass of its own."""
    o = Observation(name)
    return df.observe(o, F.count("*").alias("rows"), F.count(err).alias("errors")), o
