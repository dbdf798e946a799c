"""The error value that rows carry: kind, message, and whether a retry is pointless."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<kind:string,msg:string,permanent:boolean>"

#: The kinds of errors, and those that no retry mends.
KINDS = ("cyclic", "torn_down", "key_failed", "cancelled", "closed", "invalid_path", "user", "config")
PERMANENT = ("torn_down", "key_failed", "closed", "invalid_path")


def error(kind: str, msg: Column | str, permanent: bool | None = None) -> Column:
    if kind not in KINDS:
        raise ValueError(f"{kind} is no kind of error")
    text = F.lit(msg) if isinstance(msg, str) else msg
    sure = kind in PERMANENT if permanent is None else permanent
    return F.struct(F.lit(kind).alias("kind"), text.alias("msg"), F.lit(sure).alias("permanent"))


def none() -> Column:
    return F.lit(None).cast(SCHEMA)


def when(condition: Column, kind: str, msg: Column | str, permanent: bool | None = None) -> Column:
    """The error where the condition holds, else none."""
    return F.when(condition, error(kind, msg, permanent)).otherwise(none())
