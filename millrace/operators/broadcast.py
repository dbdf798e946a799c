"""One append-only log replayed to many subscriptions, each from its own offset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deliveries(log: DataFrame, subs: DataFrame, width: int = 1024) -> DataFrame:
    """sub_id and every log row of its [start_idx, end_idx). A range join made an equality on windows of the
    log, so that both sides are partitioned by it."""
    closed = F.coalesce("end_idx", F.lit((1 << 62)))
    last = log.agg(F.max("idx").alias("__last"))
    s = subs.crossJoin(F.broadcast(last)).withColumn("__end", F.least(closed, F.col("__last") + 1)).filter("start_idx < __end")  # one row
    s = s.withColumn("__w", F.explode(F.sequence(F.floor(F.col("start_idx") / width), F.floor((F.col("__end") - 1) / width))))
    rows = log.withColumn("__w", F.floor(F.col("idx") / width)).join(s, "__w").filter("idx >= start_idx AND idx < __end")
    return rows.select("sub_id", *log.columns)


def lag(subs: DataFrame, log: DataFrame) -> DataFrame:
    """delivered and pending of each subscription: what it took (at most ``consume`` values) and what waits."""
    tail = log.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("tail"))
    room = F.greatest(F.lit(0), F.least(F.coalesce("end_idx", F.col("tail")), F.col("tail")) - F.col("start_idx"))
    s = subs.crossJoin(F.broadcast(tail)).withColumn("room", room).withColumn("delivered", F.least(F.coalesce("consume", F.col("room")), F.col("room")))  # one row
    return s.select("sub_id", F.col("delivered").cast("long").alias("delivered"), (F.col("room") - F.col("delivered")).cast("long").alias("pending"))


def metrics(log: DataFrame, subs: DataFrame) -> DataFrame:
    """One row: sends, subscribers, delivered, pending."""
    state = lag(subs, log).agg(F.count("*").alias("subscribers"), F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered"), F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))
    return log.agg(F.count("*").alias("sends")).crossJoin(F.broadcast(state))  # one row each
