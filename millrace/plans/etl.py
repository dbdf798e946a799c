"""The violations load: strings to typed rows, block failures, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import errors, scalars
from millrace.sources.readers import VIOLATIONS


def typed(raw: DataFrame) -> DataFrame:
    """The table's columns and err: rows whose time is neither '' nor a time have one."""
    t = scalars.parse_time(F.col("violdttm"))
    out = {new: F.col(old) for old, new in VIOLATIONS.items()} | {"time": t, "level": scalars.parse_level(F.col("viollevel"))}
    bad = F.col("violdttm").isNotNull() & t.isNull()
    rest = [c for c in raw.columns if c not in VIOLATIONS]
    return raw.select(*rest, *(v.alias(k) for k, v in out.items()), errors.when(bad, "user", F.concat(F.lit("bad time "), F.col("violdttm"))).alias("err"))


def by_block(rows: DataFrame, block: str = "block_id") -> DataFrame:
    """A block with a bad row fails as a whole."""
    bad = rows.filter(F.col("err").isNotNull()).groupBy(block).agg(F.min("err").alias("__err"))
    return rows.join(bad, block, "left").withColumn("err", F.col("__err")).drop("__err")


def counts(rows: DataFrame) -> DataFrame:
    """records (the rows and the end of the file), errors, and whether a budget of a tenth holds."""
    n = rows.agg((F.count("*") + 1).alias("records"), F.count("err").alias("errors"))
    return n.withColumn("commits", F.col("errors") / F.col("records") <= 0.1)


def top_groups(rows: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The n most frequent names, ties by name. Nulls don't count."""
    return rows.groupBy(name).agg(F.count(name).alias("n")).orderBy(F.desc("n"), F.asc(name)).limit(n)


def report(violations: DataFrame, since: str = "2016-01-01") -> DataFrame:
    live = violations.filter((F.col("license_status") == "Active") & (F.col("time") >= F.lit(since).cast("timestamp_ntz")))
    return top_groups(live, "business_name").withColumnRenamed("n", "num_violations")
