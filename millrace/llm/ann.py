"""Nearest neighbours by cosine through multi-index hashing.

Codes: vectors are scaled to length 1, centred, and turned by learned rotations (iterative quantisation from
different starts); the signs are the code, cut into substrings of 16 bits, each of which indexes a table. What
the index needs is fitted on a sample of at most SAMPLE rows, the first by a hash of the id: for its true
neighbours, which are farther than those among all rows, the fit knows how far each substring is, and takes
the number of tables and the reach (the bits in which a probed value may differ) that find RECALL of them by
probing the smallest share of rows. Every row is indexed.

Search: a query probes all values within the reach of its own in each table, enumerated, not scanned. By the
pigeonhole principle that retrieves every code within tables x (reach + 1) - 1 bits for certain, and most
farther ones; all that is retrieved is ranked by the exact cosine in double precision. A query that retrieves
fewer than k rows reaches one bit further until it has k or the shard ends.

Plan: rows are dealt to shards by hash, each one task, and move once; every query goes to each shard after
its rows, in blocks that stream past the shard's tables, so that a task holds one shard and one block. A task
returns k rows a query, so the last ranking moves shards x queries x k rows, and a hot vector is just several
rows of its shards. Queries x shards is the stated query set against all rows, in blocks.

Cases: vectors that are null, of length 0, or hold null or non-finite components take no part; where vectors
differ in length, the shorter ones end in zeros; a query's own row is any with its id; rows that repeat an id
are candidates of their own and repeated queries are answered once; ties go to the smaller id; with fewer
than k candidates all are returned; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches, only, read

K, EVERY, SAMPLE, RECALL, BITS, MOST_TABLES, SEED = 5, 50, 20_000, 0.94, 16, 96, 3
LEAST_SHARD, MOST_SHARD, QUERY_BLOCK = 8192, 65_536, 1024
ONES = np.array([bin(i).count("1") for i in range(1 << BITS)], dtype=np.uint8)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1: squares neither vanish nor overflow,
    and cosines stay as they are, to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@functools.lru_cache(maxsize=BITS + 1)
def flips(reach: int) -> np.ndarray:
    """All masks of at most that many bits."""
    return np.array([sum(1 << b for b in some) for n in range(reach + 1) for some in itertools.combinations(range(BITS), n)], dtype=np.uint16)


class Codes:
    """The learned rotations, the number of tables and the reach."""

    def __init__(self, x: np.ndarray, tables: int = MOST_TABLES, steps: int = 15):
        r, d = np.random.default_rng(SEED), x.shape[1]
        x = unit(x)
        self.mean = x.mean(axis=0)
        v, turns = x - self.mean, []
        for _ in range(math.ceil(tables * BITS / d)):
            turn = np.linalg.qr(r.normal(size=(d, d)))[0]
            for _ in range(steps):
                a, _, b = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
                turn = a @ b
            turns.append(turn)
        self.turns = np.concatenate(turns, axis=1)[:, : tables * BITS]
        self.turns = np.pad(self.turns, ((0, 0), (0, -self.turns.shape[1] % BITS)))
        self.tables, self.reach = tables, BITS

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The 16-bit substrings of each row's code."""
        bits = (unit(x) - self.mean) @ self.turns[:, : self.tables * BITS] >= 0
        return (bits.reshape(len(x), self.tables, BITS) @ (1 << np.arange(BITS))).astype(np.uint16)

    def learn(self, x: np.ndarray, k: int, recall: float = RECALL, queries: int = 400) -> tuple[float, float]:
        """Chooses tables and reach; returns the recall and the share of rows probed that the sample promises."""
        if len(x) < 2:
            return 1.0, 1.0
        q, u, codes, found, best = min(queries, len(x)), unit(x), self(x), [], None
        for i in range(q):
            s = u @ u[i]
            s[i] = -2
            found.append(np.argsort(-s)[: min(k, len(x) - 1)])
        near = np.concatenate([ONES[codes[rows] ^ codes[i]] for i, rows in enumerate(found)])
        some = np.random.default_rng(SEED).integers(0, len(x), (q, 64))
        far = np.concatenate([ONES[codes[some[i]] ^ codes[i]] for i in range(q)])
        for reach in range(BITS + 1):
            caught, probed = (np.logical_or.accumulate(m <= reach, axis=1).mean(axis=0) for m in (near, far))
            enough = np.flatnonzero(caught >= recall)
            if len(enough) and (best is None or probed[enough[0]] < best[1]):
                best = float(caught[enough[0]]), float(probed[enough[0]]), int(enough[0]) + 1, reach
        if best:
            self.tables, self.reach = best[2:]
        return best[:2] if best else (1.0, 1.0)


class Shard:
    """The tables of one shard: the rows in order of each substring's value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        n, tables = codes.shape
        self.codes, self.order = codes, np.empty((tables, n), np.int32)
        self.start = np.empty((tables, (1 << BITS) + 1), np.int64)  # places in the orders of all tables, one after the other
        for j in range(tables):
            self.order[j] = np.argsort(codes[:, j], kind="stable")
            self.start[j] = n * j + np.searchsorted(codes[self.order[j], j], np.arange((1 << BITS) + 1))

    def probe(self, code: np.ndarray, reach: int) -> np.ndarray:
        """Every row with a substring within the reach of the code's: each code within
        tables x (reach + 1) - 1 bits, and others."""
        hit, masks = np.zeros(len(self.codes), bool), flips(reach)
        some = max(1, (1 << 20) // len(masks))
        for j in range(0, len(code), some):
            values = (masks ^ code[j : j + some, None]).astype(np.int64)
            at = values + np.arange(j, j + len(values))[:, None] * self.start.shape[1]
            low = self.start.ravel()[at]
            n = self.start.ravel()[at + 1] - low
            use = n > 0
            low, n = low[use], n[use]
            hit[self.order.ravel()[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]] = True
        return np.flatnonzero(hit)


class Index:
    """A shard's vectors with their tables."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: Codes):
        self.ids, self.x, self.codes = ids, scaled(x), codes
        self.norms, self.shard = np.sqrt((self.x * self.x).sum(axis=1)), Shard(codes(x))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
        """(query, id, cosine) of each query's k nearest retrieved."""
        for query, v, code in zip(query_ids.tolist(), scaled(q), self.codes(q), strict=True):
            others, reach = int((self.ids != query).sum()), self.codes.reach
            while True:
                rows = self.shard.probe(code, reach)
                rows = rows[self.ids[rows] != query]
                if len(rows) >= min(k, others) or reach >= BITS:
                    break
                reach += 1
            score = (self.x[rows] * v).sum(axis=1) / (self.norms[rows] * np.sqrt((v * v).sum()))
            best = np.lexsort((self.ids[rows], -score))[:k]
            for i in best.tolist():
                yield query, int(self.ids[rows[i]]), float(score[i])


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v: rows whose vector can take part."""
    v = F.col("v")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    return table.select("vec_id", F.col("v").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors as rows of d components; shorter ones end in zeros."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    at = at - at[0]
    if len(flat) == d * len(column):
        return flat.reshape(-1, d)
    out = np.zeros((len(column), d))
    owner = np.repeat(np.arange(len(column)), np.diff(at))
    out[owner, np.arange(len(flat)) - at[owner]] = flat
    return out


def nearest(table: DataFrame, is_query, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of table (vec_id, v) that is_query, a Column, picks."""
    spark, rows = table.sparkSession, usable(table)
    count, d = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    x = np.concatenate([matrix(c, d) for c in fitted.column("v").chunks])
    codes = Codes(x)
    codes.learn(x, k)
    broadcast = spark.sparkContext.broadcast(codes)
    shards = math.ceil(count / min(MOST_SHARD, max(LEAST_SHARD, count // 16)))
    asked = rows.filter(is_query).dropDuplicates(["vec_id"])
    mine = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(source):
        codes, at, held, index = broadcast.value, None, [], None

        def look(part):
            found = list(index.search(part.column(2).to_numpy(), matrix(part.column(3), d), k)) if index else []
            columns = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

        for batch in batches(source, QUERY_BLOCK):
            shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for low, high in itertools.pairwise([0, *cuts.tolist(), len(shard)]):
                part = batch.slice(low, high - low)
                if shard[low] != at:
                    at, held, index = shard[low], [], None
                if not asks[low]:
                    held.append((part.column(2).to_numpy(), matrix(part.column(3), d)))
                    continue
                if held:
                    index = Index(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), codes)
                    held = []
                yield look(part)

    dealt = mine.union(theirs).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return nearest(only(read(spark, sf_dir, "embeddings"), vec_id="vec_id", v="embedding"), F.col("vec_id") % EVERY == 0)

