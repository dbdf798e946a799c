"""Topics matched to patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import errors, paths

#: Deeper topics are matched pattern by pattern: their candidate keys would be too many.
DEEPEST = 8
#: Sequence numbers of one part of a pattern's changes.
PART = 1 << 16


def live_patterns(changes: DataFrame) -> DataFrame:
    """pattern, n: those with subscriptions left, of changes (seq, op, pattern); the last one out removes it, and a
    Delete where there is none is nothing. The count is the running sum less the lowest it would have sunk
    below 0, by parts: each part gives its sum and its lowest prefix, so no task holds a whole pattern."""
    valid = changes.filter(paths.pattern_error(F.col("pattern")).isNull()).withColumn("pattern", paths.canonical(F.col("pattern")))
    step = F.when(F.col("op") == "Add", 1).when(F.col("op") == "Delete", -1).otherwise(0)
    parts = valid.select("pattern", F.floor(F.col("seq") / PART).alias("part"), "seq", step.alias("step"))
    inner = Window.partitionBy("pattern", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.withColumn("at", F.sum("step").over(inner)).groupBy("pattern", "part").agg(F.sum("step").alias("sum"), F.min("at").alias("low"))
    outer = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.withColumn("before", F.coalesce(F.sum("sum").over(outer), F.lit(0)))
    return whole.groupBy("pattern").agg((F.sum("sum") - F.least(F.lit(0), F.min(F.col("before") + F.col("low")))).alias("n")).filter("n > 0")


def match(sends: DataFrame, patterns: DataFrame, topic: str = "topic", pattern: str = "pattern") -> DataFrame:
    """sends by every distinct valid pattern that matches, each once, as column ``pattern``. Each distinct topic is
    matched once: its candidate patterns are joined by equality; only topics of over DEEPEST segments are compared
    one by one."""
    known = patterns.filter(paths.pattern_error(F.col(pattern)).isNull()).select(paths.canonical(F.col(pattern)).alias("__p")).distinct()
    # the count keeps Catalyst from moving the checks of a topic below the aggregate, to every send
    counted = sends.groupBy(F.col(topic).alias("__raw")).agg(F.count("*").alias("__n"))
    distinct = counted.select(F.when(F.col("__n") > 0, F.col("__raw")).alias("__topic"))
    valid = distinct.filter(paths.topic_error(F.col("__topic")).isNull())
    deep = F.size(paths.segments(F.col("__topic"))) > DEEPEST
    near = valid.filter(~deep).withColumn("__key", F.explode(paths.candidate_keys(F.col("__topic"))))
    near = near.join(known, F.col("__key") == F.col("__p")).drop("__key")
    roots = known.withColumn("__root", F.element_at(paths.segments(F.col("__p")), 1))
    first = F.element_at(paths.segments(F.col("__topic")), 1)
    far = valid.filter(deep).withColumn("__first", F.explode(F.array(first, F.lit("*"), F.lit("**"))))
    far = far.join(roots, F.col("__first") == F.col("__root")).filter(paths.matches(F.col("__topic"), F.col("__p"))).drop("__first", "__root")
    pairs = near.unionByName(far)
    return sends.join(pairs, F.col(topic) == F.col("__topic")).drop("__topic").withColumnRenamed("__p", "pattern")


def deliver(matched: DataFrame, subscriptions: DataFrame, seq: str = "seq") -> DataFrame:
    """Each match to every subscription of its pattern that was open at that point of the log."""
    subs = subscriptions.select("sub_id", paths.canonical(F.col("pattern")).alias("__p"), "start_idx", "end_idx")
    inside = (F.col(seq) >= F.col("start_idx")) & (F.col(seq) < F.coalesce("end_idx", F.lit((1 << 63) - 1)))
    return matched.join(subs, (F.col("pattern") == F.col("__p")) & inside).drop("__p", "start_idx", "end_idx")


def send_errors(sends: DataFrame, closed_at: int | None, topic: str = "topic", seq: str = "seq") -> DataFrame:
    """err of each send: closed from that point on, whatever the topic; else what is wrong with the topic."""
    shut = F.lit(False) if closed_at is None else F.col(seq) >= closed_at
    return sends.withColumn("err", F.coalesce(errors.when(shut, "closed", "the subscriber is closed"), paths.topic_error(F.col(topic))))


def metrics(sends: DataFrame, patterns: DataFrame, key: str = "seq", topic: str = "topic") -> DataFrame:
    """One row: sends (valid ones), matches (distinct patterns matched), unmatched, topics (live patterns)."""
    valid = sends.filter(paths.topic_error(F.col(topic)).isNull())
    per = match(valid, patterns, topic).groupBy(key).agg(F.count("*").alias("m"))
    known = patterns.filter(paths.pattern_error(F.col("pattern")).isNull()).agg(F.count_distinct(paths.canonical(F.col("pattern"))).alias("topics"))
    counts = valid.select(key).join(per, key, "left").agg(F.count("*").alias("sends"), F.coalesce(F.sum("m"), F.lit(0)).alias("matches"), F.count_if(F.col("m").isNull()).alias("unmatched"))
    return counts.crossJoin(F.broadcast(known))  # one row each
