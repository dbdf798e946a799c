"""Small functions of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the stars of a violation level stand for, and the names of changelog operations.
LEVELS = {"*": 1, "**": 2, "***": 3}
OPS = {0: "UnknownOp", 1: "Add", 2: "Delete"}
ZERO_TIME = "0001-01-01 00:00:00"


def parse_level(stars: Column) -> Column:
    out = F.lit(-1)
    for text, level in LEVELS.items():
        out = F.when(stars == text, level).otherwise(out)
    return out


def parse_time(text: Column) -> Column:
    """The time; the zero time for '', null where it can't be parsed."""
    return F.when(text == "", F.lit(ZERO_TIME).cast("timestamp_ntz")).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def clamp(v: Column, low: Column, high: Column) -> Column:
    """The lower bound is tested first, so it wins where the bounds cross."""
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def clamp_delta(delta: Column, workers: Column, low: Column, high: Column) -> Column:
    return clamp(workers + delta, low, high) - workers


def lane(key: Column, lanes: int) -> Column:
    if lanes < 1:
        raise ValueError("there must be at least one lane")
    return F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int")


def op_name(op: Column) -> Column:
    out = F.concat(F.lit("Op("), op.cast("string"), F.lit(")"))
    for code, name in OPS.items():
        out = F.when(op == code, name).otherwise(out)
    return out


def bit(mask: Column, n: Column) -> Column:
    return F.expr("true") & (F.call_function("shiftright", mask, n).bitwiseAND(F.lit(1)) == 1)


def set_bit(mask: Column, n: Column) -> Column:
    return mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), n))


def reverse_bytes(b: Column) -> Column:
    """Bytes from last to first, through pairs of hex digits."""
    h = F.hex(b)
    pairs = F.transform(F.sequence(F.lit(0), F.octet_length(b) - 1), lambda i: F.substring(h, F.octet_length(b) * 2 - i * 2 - 1, F.lit(2)))
    return F.when(F.octet_length(b) == 0, b).otherwise(F.unhex(F.array_join(pairs, "")))


def trim_space(text: Column) -> Column:
    """Without any white space at the ends, also beyond ASCII."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def as_json(*columns: str) -> Column:
    """The data columns of a request as one JSON text."""
    return F.to_json(F.struct(*columns))


def quotient(a: Column, b: Column | int) -> Column:
    """Whole division that truncates to zero, in whole numbers throughout."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a.cast("long"), b.cast("long"))
