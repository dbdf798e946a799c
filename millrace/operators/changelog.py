"""Keyed tables from operations (seq, op, k, v, err)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import keyed


def known(op: Column) -> Column:
    """Whether it is a kind of operation."""
    return F.coalesce(op.isin("Add", "Delete"), F.lit(False))


def cut_at_error(ops: DataFrame) -> DataFrame:
    """The operations before the first with an error, or of no known kind, which ends the feed."""
    first = ops.filter(F.col("err").isNotNull() | ~known(F.col("op"))).agg(F.min("seq").alias("__first"))
    return ops.crossJoin(F.broadcast(first)).filter(F.col("__first").isNull() | (F.col("seq") < F.col("__first"))).drop("__first")  # one row


def materialise(ops: DataFrame) -> DataFrame:
    """k, v: the last operation of a key wins, and a Delete leaves nothing. Folds map-side."""
    last = ops.groupBy("k").agg(F.max_by(F.struct("op", "v"), "seq").alias("last"))
    return last.filter("last.op = 'Add'").select("k", "last.v")


def accept_greater(ops: DataFrame) -> DataFrame:
    """k, v where an Add is accepted only if it is greater than what is there: the greatest since the last Delete."""
    gone = F.max(F.when(F.col("op") == "Delete", F.col("seq")))
    last = ops.groupBy("k").agg(gone.alias("__gone")).withColumnRenamed("k", "__k")
    live = ops.join(last, F.col("k").eqNullSafe(F.col("__k"))).filter((F.col("op") == "Add") & (F.col("__gone").isNull() | (F.col("seq") > F.col("__gone"))))
    return live.groupBy("k").agg(F.max("v").alias("v"))


def accept(ops: DataFrame, on_set: Callable | None = None, on_delete: Callable | None = None) -> DataFrame:
    """k, v, err of each key's last state with hooks: on_set(k, v, prev, replaced) and on_delete(k, prev, found)
    say whether the change is made; what they raise leaves the table as it is and is the key's err, as is an
    operation of no known kind."""
    kinds = dict(ops.dtypes)

    def step(state, row):
        found, prev = state
        try:
            if row.op == "Add":
                if on_set is None or on_set(row.k, row.v, prev, found):
                    return (True, row.v), [(row.k, row.seq, True, row.v, None)]
            elif row.op != "Delete":
                return state, [(row.k, row.seq, found, prev, f"no such operation: {row.op}")]
            elif on_delete is None or on_delete(row.k, prev, found):
                return (False, None), [(row.k, row.seq, False, None, None)]
        except Exception as e:  # noqa: BLE001  a hook's error is its result
            return state, [(row.k, row.seq, found, prev, str(e))]
        return state, [(row.k, row.seq, found, prev, None)]

    states = keyed.fold(ops.select("k", "seq", "op", "v"), "k", "seq", step, lambda: (False, None), f"k {kinds['k']}, seq long, found boolean, v {kinds['v']}, err string")
    last = states.groupBy("k").agg(F.max_by(F.struct("found", "v"), "seq").alias("s"), F.max_by("err", "seq").alias("err"))
    return last.filter("s.found").select("k", "s.v", "err")


def get(table: DataFrame, key: Column | str) -> DataFrame:
    return table.filter(F.col("k") == key)
