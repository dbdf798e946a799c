"""Topic paths: segments divided by '/', and patterns with '*' and a last '**'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import errors


def segments(path: Column) -> Column:
    """The segments; one leading '/' is dropped. Only right where ``path_error`` is null."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def path_error(path: Column) -> Column:
    bad = path.isNull() | (path == "") | path.endswith("/") | F.exists(segments(path), lambda s: s == "")
    return errors.when(bad, "invalid_path", F.concat(F.lit("bad path "), F.coalesce(path, F.lit(""))))


def topic_error(topic: Column) -> Column:
    """A topic is a path without any '*'."""
    return F.coalesce(path_error(topic), errors.when(topic.contains("*"), "invalid_path", F.concat(F.lit("wildcard in topic "), topic)))


def pattern_error(pattern: Column) -> Column:
    """A wildcard is a whole segment, and '**' the last."""
    s = segments(pattern)
    part = F.exists(s, lambda x: x.contains("*") & ~x.isin("*", "**"))
    early = F.exists(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), lambda x: x == "**")
    return F.coalesce(path_error(pattern), errors.when(part | early, "invalid_path", F.concat(F.lit("bad wildcard in "), pattern)))


def canonical(path: Column) -> Column:
    return F.array_join(segments(path), "/")


def matches(topic: Column, pattern: Column) -> Column:
    """Whether a valid pattern matches a valid topic; for a few patterns, or topics too deep for candidate keys."""
    t, p = segments(topic), segments(pattern)
    rest = F.element_at(p, -1) == "**"
    fixed = F.when(rest, F.size(p) - 1).otherwise(F.size(p))
    enough = F.when(rest, F.size(t) >= fixed).otherwise(F.size(t) == fixed)
    pairs = F.zip_with(F.slice(t, F.lit(1), fixed), F.slice(p, F.lit(1), fixed), lambda a, b: (b == "*") | (a == b))
    return enough & F.forall(pairs, lambda x: x)


def candidate_keys(topic: Column) -> Column:
    """Every pattern that could match a valid topic of few segments: 2^d whole ones and 2^(d + 1) - 1 that end in '**'."""

    def grow(prefixes, segment):
        return F.flatten(F.transform(prefixes, lambda x: F.array(F.concat(x, F.lit("/"), segment), F.concat(x, F.lit("/*")))))

    s = segments(topic)
    start = F.array(F.lit("").cast("string"))
    whole = F.aggregate(s, start, grow)
    ends = F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), lambda n: F.aggregate(F.slice(s, F.lit(1), n), start, grow)))
    keys = F.concat(whole, F.transform(ends, lambda x: F.concat(x, F.lit("/**"))))
    return F.array_distinct(F.transform(keys, lambda x: F.substring(x, 2, 1 << 30)))
