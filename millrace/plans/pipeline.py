"""Staged pipelines: each row walks from stage to stage as its data says.

The envelope columns of a request are group_id, item_num, key, seq, next_stage, err, visited and hops. A stage
is a set of column expressions and a routing expression; all stages of one hop are folded into one projection
of CASE expressions, so that Catalyst fuses hops into one stage of code. Acyclic routes take as many hops as
there are stages, at most; loops take ``max_hops``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import errors

ENVELOPE = ("next_stage", "err", "visited", "hops")
#: Under this name a preprocessor gives the text of its error, null if none: such a request goes no further.
FAILS = "__fails"


@dataclass
class Stage:
    """sets: what the stage makes of data columns. next: the following stage's name, null to leave. fails: the
    text of the stage's own error, null if none; the stage's columns are set all the same."""

    name: str
    sets: dict[str, Column] = field(default_factory=dict)
    next: Column | str | None = None
    fails: Column | None = None


@dataclass
class Pipeline:
    stages: list[Stage]
    start: str
    dag: bool = False
    preprocessors: list[Callable[[DataFrame], dict[str, Column]]] = field(default_factory=list)
    max_hops: int | None = None

    def __post_init__(self):
        names = [s.name for s in self.stages]
        if not names:
            raise ValueError("a pipeline has at least one stage")
        if len(set(names)) != len(names):
            raise ValueError("stages need different names")
        if self.start not in names:
            raise ValueError(f"{self.start} is no stage")
        if self.max_hops is not None and self.max_hops < 1:
            raise ValueError("max_hops must be at least 1")

    def workers(self, num: int, substages: int = 0) -> int:
        """How many tasks at a time the pipeline asks for: num whole pipelines, a worker a stage."""
        if num < 1 or substages < 0:
            raise ValueError("num must be at least 1 and substages not negative")
        return num * (len(self.stages) + substages)

    def run(self, df: DataFrame, group: str | None = None, pos: str | None = None) -> DataFrame:
        """df with the envelope after the walk; with group and pos, in submit order within each group."""
        df = df.withColumns({"next_stage": F.lit(self.start), "err": errors.none(), "visited": F.array().cast("array<string>"), "hops": F.lit(0)})
        hops = self.max_hops or len(self.stages) + bool(self.dag)
        for _ in range(hops):
            df = self.hop(df)
        why = "the route is a loop: set max_hops" if self.max_hops is None else f"not at its end after {hops} hops"
        over = F.col("err").isNull() & F.col("next_stage").isNotNull()
        df = df.withColumn("err", F.when(over, errors.error("config", why)).otherwise(F.col("err")))
        return df if group is None else df.orderBy(group, pos)

    def hop(self, df: DataFrame) -> DataFrame:
        """One more stage for every row that is still on its way."""
        if self.dag:
            again = F.array_contains("visited", F.col("next_stage")) & F.col("err").isNull()
            df = df.withColumn("err", F.when(again, errors.error("cyclic", F.array_join("visited", " -> "))).otherwise(F.col("err")))
        going = F.col("err").isNull() & F.col("next_stage").isNotNull()
        df = df.withColumn("__at", F.when(going, F.col("next_stage")))
        for p in self.preprocessors:
            made, here = dict(p(df)), F.col("__at").isNotNull()
            fails = made.pop(FAILS, None)
            new = {c: F.when(here, v).otherwise(F.col(c)) for c, v in made.items()}
            df = df.withColumns(new if fails is None else new | {FAILS: F.when(here, fails)})
            if fails is not None:  # the request leaves before the stage's body
                df = df.withColumn("err", F.coalesce(F.col("err"), errors.when(F.col(FAILS).isNotNull(), "user", F.col(FAILS)))).drop(FAILS)
                df = df.withColumns({"next_stage": F.when(F.col("__at").isNull() | F.col("err").isNull(), F.col("next_stage")), "__at": F.when(F.col("err").isNull(), F.col("__at"))})
        out: dict[str, Column] = {}
        for s in self.stages:
            here = F.col("__at") == s.name
            for c, v in s.sets.items():
                out[c] = F.when(here, v).otherwise(out.get(c, F.col(c)))
        following, failed = F.lit(None).cast("string"), errors.none()
        for s in self.stages:
            here = F.col("__at") == s.name
            if s.next is not None:
                following = F.when(here, F.lit(s.next) if isinstance(s.next, str) else s.next).otherwise(following)
            if s.fails is not None:
                failed = F.when(here & s.fails.isNotNull(), errors.error("user", s.fails)).otherwise(failed)
        moved = F.col("__at").isNotNull()
        out |= {
            "err": F.coalesce(F.col("err"), failed),
            "next_stage": F.when(moved, F.when(failed.isNull(), following)).otherwise(F.col("next_stage")),
            "visited": F.when(moved, F.concat("visited", F.array("__at"))).otherwise(F.col("visited")),
            "hops": F.col("hops") + moved.cast("int"),
        }
        return df.withColumns(out).drop("__at")


def mux(groups: dict[int, DataFrame]) -> DataFrame:
    """All groups' rows in one input, told apart by group_id; a group's rows come back by filtering on it."""
    out = None
    for k, df in groups.items():
        df = df.withColumn("group_id", F.lit(k).cast("long"))
        out = df if out is None else out.unionByName(df)
    return out
