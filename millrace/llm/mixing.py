"""Mixing sources to target weights with a low-discrepancy schedule.

Slot n of the mix takes its source from the golden-ratio point frac((n + 0.5) * phi), mapped through the
cumulative targets, so every prefix of the mix is close to the target weights. A slot's rank among its
source's slots names a block: the source's documents, in the order of a seeded hash, form an endless
repeated line of words, and block r is words [r * B, (r + 1) * B) of it.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at ``most`` times its
source's words; the excess is shared among the others by weight until none is above.

Plan: everything is counted in two levels, so no window holds a whole source: hash ranges of documents
within a source and chunks of consecutive slots get per-chunk sums, prefix sums run over those sums only,
and the rows are ranked within a chunk. The join of documents with slots is on (source, block), a unique
key on the schedule's side. Only the sources' totals go to the driver: one row a
source, and their table is broadcast up to FEW sources only.

Block size: ``block`` words, less for a small corpus, so that there are at least ``slots`` slots and
rounding a source to whole blocks stays near its target.

Cases: a null or empty text has size 0 and takes 0; a null source is one source, last; repeated rows are
documents of their own; null ids hash as empty; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import TOKEN, only, read, stash

PHI, BLOCK, SLOTS, MOST, WEIGHTS = 0.6180339887498949, 1024, 20_000, 3, (1.0, 2.0, 3.0)
CHUNK = 1 << 14
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
FEW = 100_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the summed sizes by weight, none above ``most`` times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.remove(i)
        left = float(sum(sizes)) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def schedule(spark: SparkSession, goals: list[float], block: int) -> DataFrame:
    """slot, k (the source's index), rank (the slot's number among that source's slots)."""
    total = sum(goals)
    slots = math.ceil(total / block)
    ends = np.cumsum(goals) / total if total else np.array([1.0])

    def choose(frames):
        for f in frames:
            x = (f["slot"].to_numpy() + 0.5) * PHI
            f["k"] = np.minimum(np.searchsorted(ends, x - np.floor(x), side="right"), len(ends) - 1).astype("int32")
            yield f

    points = spark.range(slots).withColumnRenamed("id", "slot").mapInPandas(choose, "slot long, k int")
    points = points.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    before = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = points.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    base = counts.select("k", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    return points.withColumn("within", within).join(base, ["k", "chunk"]).select("slot", "k", (F.col("base") + F.col("within")).alias("rank"))


def light(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= FEW else sources


def lay_out(sized: DataFrame, seed: int, carry: tuple = ()) -> DataFrame:
    """Adds ``at``: the words before this document in its source's shuffled line. Documents of one id stand by
    their size, then by the columns to carry."""
    keyed = sized.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")))
    keyed = keyed.withColumn("bucket", F.substring("h", 1, 3))
    sums = keyed.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return placed.join(base, ["k", "bucket"]).select("doc_id", "k", "size", *carry, (F.col("base") + F.col("inner")).alias("at"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = 42, carry: tuple = ()):
    """(assignment, placed, sources) of documents with columns doc_id, source, text.

    assignment: doc_id, k, at, epoch, slot, start, words: the slot of the mix takes these words of the
    document. placed: doc_id, k, size, the columns to carry, at. sources: k, source, source_size, target."""
    spark = docs.sparkSession
    sized = stash(docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("size")))
    found = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    sizes = [n for _, n in found]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    rows = [(i, s, n, float(t)) for i, ((s, n), t) in enumerate(zip(found, goals, strict=True))]
    sources = spark.createDataFrame(rows, "k int, source string, source_size long, target double")
    keyed = sized.join(light(sources.select("k", F.col("source").alias("of")), len(rows)), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "k", "size", *carry)
    placed = stash(lay_out(keyed, seed, carry))

    total = sum(sizes)
    block = max(1, min(block, total // slots))
    plan = schedule(spark, goals, block) if total else spark.createDataFrame([], "slot long, k int, rank long")
    lines = sources.select("k", F.col("source_size").alias("line"), F.ceil(F.col("target") / block + 16).alias("blocks"))
    long = placed.filter("size > 0").join(light(lines, len(rows)), "k")
    epochs = F.least(F.lit(most), F.ceil(F.col("blocks") * block / F.col("line"))).cast("int")
    turns = long.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("start", F.col("epoch") * F.col("line") + F.col("at"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = turns.withColumn("rank", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("rank") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block)
    pieces = cut.select("doc_id", "k", "at", "epoch", "rank", (low - F.col("start")).alias("start"), (high - low).alias("words"))
    return pieces.join(plan, ["k", "rank"]).drop("rank"), placed, sources


def taken(docs: DataFrame, carry: tuple = (), **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: the words the mix takes of each document,
    repeats counted; and the columns to carry."""
    assignment, placed, sources = mix(docs, carry=carry, **options)
    got = assignment.groupBy(F.col("k").alias("of"), F.col("at").alias("there")).agg(F.sum("words").alias("got"))
    rows = placed.join(got, (F.col("size") > 0) & (F.col("k") == F.col("of")) & (F.col("at") == F.col("there")), "left")
    rows = rows.select("doc_id", "k", "size", *carry, F.coalesce("got", F.lit(0)).cast("long").alias("taken"))
    return rows.join(light(sources, sources.count()), "k").select("doc_id", "source", "size", "source_size", "target", "taken", *carry)


def query(spark, sf_dir):
    return taken(only(read(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text"))


SQL = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM z GROUP BY source),
w AS (SELECT *, (k % 3 + 1)::DOUBLE AS w, {MOST} * source_size AS cap FROM s),
t AS (SELECT sum(source_size)::DOUBLE AS total, greatest(1, least({BLOCK}, sum(source_size)::BIGINT // {SLOTS})) AS block FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS caps, sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
      FROM w WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - caps) * w / ws > cap AS capped FROM f, t),
l AS (SELECT any_value(total) - coalesce(sum(cap) FILTER (capped), 0) AS remains, sum(w) FILTER (NOT capped) AS whole FROM c),
g AS (SELECT source, source_size, k, total, block, CASE WHEN capped THEN cap::DOUBLE ELSE remains * w / whole END AS target FROM c, l),
e AS (SELECT *, sum(target) OVER (ORDER BY k) / total AS hi, k = max(k) OVER () AS final FROM g),
b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo FROM e),
p AS (SELECT (n + 0.5::DOUBLE) * {PHI}::DOUBLE - floor((n + 0.5::DOUBLE) * {PHI}::DOUBLE) AS x
      FROM (SELECT unnest(range(ceil(total / block)::BIGINT)) AS n FROM t)),
q AS (SELECT b.source, source_size, k, target, block * count(x) AS words FROM b LEFT JOIN p ON x >= lo AND (x < hi OR final) GROUP BY b.source, source_size, k, target, block),
a AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '42', doc_id::VARCHAR)), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM z)
SELECT doc_id, a.source, size, source_size, target,
       list_sum([greatest(0, least(n * source_size + pos + size, words) - n * source_size - pos) for n in range({MOST})])::BIGINT AS taken
FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source
"""
