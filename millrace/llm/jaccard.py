"""Near duplicates: a Jaccard join on word n-grams through a MinHash LSH forest, verified exactly.

Classes are texts with equal shingle sets; their links are the pairs of classes with similarity >= S.

Forest: a class has TREES signatures of DEPTH minimum hashes of 16 bits. Each tree's signatures are sorted,
which lays its prefix trie out in order: what shares a prefix stands together, and how long a prefix two
neighbours share is seen in passing. Documents are matched on the whole signature first. What is found is
verified exactly, and the similarities found say how many links that level is expected to have missed: a link
of similarity s is found at depth d with chance p = 1 - (1 - s^d)^TREES and so stands for (1 - p) / p more. A
document whose links reach the target recall by that is settled; for all others, those without a link among
them, the prefix is shortened to the next of the levels. The last level is the longest prefix at which a link
of the least similarity reaches the recall, so a link of an unsettled document is missed with a chance of
1 - recall at most. A settled one is found there too, by the other side, unless both are settled.

Pairs are never rows. Documents under one prefix are tied to the first of them, one row each; connected
ties form candidate groups, which hold every candidate pair. A group's shingle sets meet in blocks of about
BLOCK documents and FULL shingles at most: each pair of blocks is one small task that intersects sets as matrix products and keeps,
for each document, the number of its links, and one tie for each linked part. The ties, joined again, are
the groups of linked documents. A group that a shorter prefix leaves as it was, or in which all are settled,
is not compared again.

Plan: exact copies are folded by digest with partial aggregation before anything else, so a group of copies
costs one row a task. Tries are sorted by ranges of (tree, signature, class), so that a prefix that a third
of all texts share is spread over tasks; a run that goes on in the next task is tied by the tasks' first and
last rows, the only rows that come to the driver. Texts are read twice and never shuffled: the second
time a filter of fixed size picks the candidates', whose shingle sets go on. Joining ties is the alternation of large-star and small-star, each round cut by a written
table, so that Spark can split a node with very many ties; tables of earlier rounds are deleted.

Shingles: n words that follow one another, as they stand; a text of fewer words is one shingle of them all.

Cases: null and empty texts have no shingle and are a class with no links and themselves as group; repeated
rows and repeated or null ids are members of their class like others; ids may be of any type with an order;
a class's and a group's id is the smallest id in it, null if all are; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from millrace.llm.common import Bounded, batches, discard, frugal, only, read, stash, texts

N, SIMILARITY, TREES, DEPTH, RECALL, BLOCK, FULL, SEED = 5, 0.8, 32, 10, 0.9999, 512, 1 << 20, 11
#: Bits of the filter that picks candidates' texts: 16 MB.
FILTER = 1 << 27
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33))


def depth_for(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that still reaches the recall; at least 1."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def levels_for(similarity: float, recall: float) -> list[int]:
    """The prefix lengths that are tried, longest first: the whole, one between, and the last."""
    last = depth_for(similarity, recall)
    return sorted({DEPTH, (DEPTH + last) // 2, last}, reverse=True)


def missed(s: np.ndarray, depth: int) -> np.ndarray:
    """How many links of that similarity are expected to be missed at that depth for each that is found."""
    lost = (1 - s**depth) ** TREES
    return lost / (1 - lost)


class Hashes(Bounded):
    """The 64-bit hashes of words."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.of)
        if self.room(new):
            new = set(words)
        self.of.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(self.of.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> MIX[2])) * MIX[0]
        h = (h ^ (h >> MIX[2])) * MIX[1]
        return h ^ (h >> MIX[2])


def shingles(text: bytes, n: int = N, known: Hashes | None = None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h = (Hashes() if known is None else known)(words)
    size = max(1, len(h) - n + 1)
    out = np.full(size, len(words) if len(h) < n else n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(n, len(h))):
            out = mix(out * MIX[0] + h[k : k + size])
    return np.unique(out)


@functools.lru_cache(maxsize=4)
def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    odd, more = (r.integers(0, 1 << 63, count, dtype=np.uint64) for _ in range(2))
    return (odd * np.uint64(2) + np.uint64(1))[:, None], more[:, None]


def signature(s: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[bytes]:
    """Each tree's minimum hashes, 16 bits of each, as bytes that sort like their prefixes."""
    odd, more = permutations(trees * depth)
    least = np.full(trees * depth, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            least = np.minimum(least, ((s[None, i : i + 1024] ^ more) * odd).min(axis=1))
        keys = (mix(least) >> np.uint64(48)).astype(">u2").tobytes()
    return [keys[i : i + 2 * depth] for i in range(0, len(keys), 2 * depth)]


def sign(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, class (a digest of the shingle set, null if empty), size, signature (one a tree)."""

    def run(source):
        known = Hashes()
        for batch in batches(source):
            digests, sizes, trees = [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, n, known)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                trees.append(signature(s) if len(s) else None)
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(trees, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "size", "signature"])

    out = [docs.schema["doc_id"], StructField("class", BinaryType()), StructField("size", IntegerType()), StructField("signature", ArrayType(BinaryType()))]
    return docs.select("doc_id", "text").mapInArrow(frugal(run), StructType(out))


def components(ties: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each connected part of the ties, by alternating large-star and small-star."""
    h = F.xxhash64("u", "v")
    state = lambda edges: edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).first()
    edges = stash(ties.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u != v").distinct())
    before = state(edges)
    for _ in range(rounds if before[0] else 0):
        # large-star: every larger neighbour of a node is tied to the smallest of its neighbours and itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a plain shuffle on both sides and Spark can split a node with many ties
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: every smaller neighbour of a node, and the node, are tied to the smallest of them
        small = large.distinct()
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        tied = small.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v")))
        old, edges = edges, stash(tied.distinct())
        discard(old, least)
        before, now = state(edges), before
        if now == before:
            break
    else:
        if before[0]:
            raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shared(keys: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """How many values each row's signature shares with that of the row before it, from the second row on."""
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], same, 0)


def walk(classes: DataFrame, levels: list[int]) -> DataFrame:
    """a, b, level: a row of a tree's sorted signatures tied to the first one with which it shares a prefix of
    that level, in the same task; a tie that a longer level has already is left out. With level -1 and -2 the
    first and the last row of each task: a is its class, besides part, tree and key."""
    rows = classes.select(F.posexplode("signature").alias("tree", "key"), "class")
    order = ("tree", "key", "class")

    def run(source):
        part, last, firsts, ends = TaskContext.get().partitionId(), None, [None] * len(levels), []
        for batch in source:
            if not batch.num_rows:
                continue
            tree, name = batch.column(0).to_numpy(), batch.column(2)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(len(tree), -1)
            if last is None:
                ends.append((int(tree[0]), keys[0].tobytes(), name[0].as_py(), -1))
                last = tree[0] - 1, keys[0]
            both = shared(np.concatenate([last[1][None], keys]), np.concatenate([[last[0]], tree]))
            at, before, out = np.arange(len(tree)), np.full(len(tree), -2), []
            for k, level in enumerate(levels):
                begin = np.maximum.accumulate(np.where(both < level, at, -1))  # -1: began in an earlier batch
                tied = np.flatnonzero((begin != at) & ((begin != before) | (before == -2)))
                if k and len(tied):  # began earlier at both levels: the same tie if their first rows are one
                    tied = tied[~((begin[tied] == -1) & (before[tied] == -1) & (firsts[k] == firsts[k - 1]))]
                heads = name.take(pa.array(np.maximum(begin[tied], 0))).to_pylist()
                out += [(a, firsts[k] if i < 0 else b, level) for a, b, i in zip(name.take(pa.array(tied)).to_pylist(), heads, begin[tied].tolist(), strict=True)]
                before = begin
                if begin[-1] >= 0:
                    firsts[k] = name[int(begin[-1])].as_py()
            last = tree[-1], keys[-1]
            final = int(tree[-1]), keys[-1].tobytes(), name[len(tree) - 1].as_py(), -2
            yield table([(*x, None, None, None) for x in out])
        if last is not None:
            yield table([(name, None, level, part, tree, key) for tree, key, name, level in (*ends, final)])

    def table(found):
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "level", "part", "tree", "key"])

    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.mapInArrow(frugal(run), "a binary, b binary, level int, part int, tree int, key binary")


def tie(classes: DataFrame, levels: list[int]) -> DataFrame:
    """a, b, level: ties that connect, with those of longer levels, whatever shares a prefix of that level; a written table."""
    walked = stash(walk(classes, levels))
    ends, over = sorted((r["part"], -r["level"], r["tree"], bytes(r["key"]), bytes(r["a"])) for r in walked.filter("level < 0").collect()), []
    for one, two in zip(ends[1::2], ends[2::2], strict=False):  # the last row of a task and the first of the next
        keys = np.frombuffer(one[3] + two[3], ">u2").reshape(2, -1)
        n = int(shared(keys, np.array([one[2], two[2]]))[0])
        over += [(one[4], two[4], level) for level in levels if n >= level][:1]
    more = classes.sparkSession.createDataFrame(over, "a binary, b binary, level int")
    ties = stash(walked.filter("level > 0").select("a", "b", "level").union(more))
    discard(walked)
    return ties


class Bunch:
    """Documents of one block: classes, how many members each has, shingle sets."""

    def __init__(self):
        self.names, self.sides, self.members, self.sets = [], [], [], []


def compare(bunch: Bunch, same: bool, similarity: float):
    """Links of each document with those of the other side, or with all if there is one block only, and similarities."""
    sets, n = bunch.sets, len(bunch.sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(at)
    use = often[at] > 1  # a shingle of one document only is in no intersection
    number = np.cumsum(often > 1) - 1
    owner = np.repeat(np.arange(n), sizes)
    owner, at = owner[use], number[at[use]]
    both, width = np.zeros((n, n), np.float32), int((often > 1).sum())
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    edges = np.searchsorted(at, np.arange(0, width + 8192, 8192))
    side = np.zeros(n) if same else np.array(bunch.sides)
    mine, theirs = (slice(None), slice(None)) if same else (np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0]))
    across = np.zeros((len(side[mine]), len(side[theirs])), np.float32)
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):  # exact: counts stay below 2^24 a slab
        dense = np.zeros((n, 8192), np.float32)
        dense[owner[lo:hi], at[lo:hi] - i * 8192] = 1
        across += dense[mine] @ dense[theirs].T
    if same:
        both = across
    else:
        both[np.ix_(mine, theirs)], both[np.ix_(theirs, mine)] = across, across.T
    shared = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    alike = shared / union
    linked = alike >= similarity
    np.fill_diagonal(linked, False)
    if not same:
        linked &= side[:, None] != side[None, :]
    return linked, alike


def roots(linked: np.ndarray) -> np.ndarray:
    """For each document the first one of its linked part."""
    out = np.full(len(linked), -1)
    for i in range(len(linked)):
        if out[i] < 0:
            todo = [i]
            out[i] = i
            while todo:
                near = np.flatnonzero(linked[todo].any(axis=0) & (out < 0))
                out[near] = i
                todo = near.tolist()
    return out


def verify(sets: DataFrame, similarity: float, level: int) -> DataFrame:
    """class, links, missed, tie: for each class and block pair its number of links (members counted), how many
    the level is expected to have missed, and a tie.

    sets: class, root, members, shingles, blocks (how many its group has)."""
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "members", "shingles")

    def run(source):
        held, key, out = Bunch(), None, []

        def close():
            if key is not None and len(held.sets) > 1:
                linked, alike = compare(held, key[1] == key[2], similarity)
                members = np.array(held.members, dtype=np.int64)
                links, lost = linked @ members, np.where(linked, missed(alike, level), 0.0) @ members
                for k, r in zip(np.flatnonzero(links).tolist(), roots(linked)[links > 0].tolist(), strict=True):
                    out.append((held.names[k], int(links[k]), float(lost[k]), held.names[r]))

        for batch in batches(source, 512):
            columns = [batch.column(k).to_pylist() for k in range(6)]
            lists = batch.column(6).to_pylist()
            for root, i, j, own, name, members, s in zip(*columns, lists, strict=True):
                if (root, i, j) != key:
                    close()
                    held, key = Bunch(), (root, i, j)
                held.names.append(name)
                held.sides.append(own)
                held.members.append(members)
                held.sets.append(np.frombuffer(s, np.uint64))
            yield table(out)
            out.clear()
        close()
        yield table(out)

    def table(rows):
        columns, kinds = list(zip(*rows, strict=True)) or [()] * 4, (pa.binary(), pa.int64(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["class", "links", "missed", "tie"])

    together = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return together.mapInArrow(frugal(run), "class binary, links long, missed double, tie binary")


def marks(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of each id of the one column: FILTER bits, however many ids there are."""
    hashed = ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(FILTER)).cast("int").alias("h"))
    words = hashed.selectExpr("h div 32 AS word", "shiftleft(1L, h % 32) AS bit")
    found, out = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow(), np.zeros(FILTER // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """class, shingles, size, one row each class, of documents whose id is among ids, and a few whose hash is."""
    of = docs.sparkSession.sparkContext.broadcast(marks(ids))

    def run(source):
        known = Hashes()
        for batch in batches(source):
            h = batch.column(0).to_numpy()
            some = batch.column(1).filter(pa.array((of.value[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1))
            sets = [shingles(t, n, known).tobytes() for t in texts(some)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int32())], ["class", "shingles", "size"])

    hashed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).alias("h"), "text")
    return hashed.mapInArrow(frugal(run), "class binary, shingles binary, size int").dropDuplicates(["class"])


def climb(ties: DataFrame, sets: DataFrame, similarity: float, recall: float, levels: list[int], block: int) -> DataFrame:
    """class, links, missed, tie of all classes with links; sets: class, members, shingles, size of all that are tied."""
    found = groups = None
    there = {r["level"] for r in ties.select("level").distinct().collect()}
    for level in [x for x in levels if x in there] or levels[-1:]:
        new = ties.filter(F.col("level") == level).select("a", "b")
        known, of = groups, components(new if groups is None else new.union(groups.select("node", "root")))
        of = of.union(of.select(F.col("root").alias("node"), "root").distinct())
        groups = stash(of.join(sets.select(F.col("class").alias("node"), "size"), "node"))
        sizes = groups.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("whole"))
        if known is not None:
            # a group goes on if it is not what it was before, and somebody in it is not settled
            enough = found.groupBy("class").agg(F.sum("links").alias("links"), F.sum("missed").alias("missed"))
            settled = enough.filter(F.col("missed") <= (1 - recall) * F.col("links")).select(F.col("class").alias("node"), F.lit(1).alias("settled"))
            state = groups.join(known.select("node", F.col("root").alias("was")), "node", "left").join(settled, "node", "left")
            grown = (F.count("was") < F.count("*")) | (F.min("was") != F.max("was"))
            open_ = state.groupBy("root").agg(grown.alias("grown"), F.count("settled").alias("settled"), F.count("*").alias("n"), F.sum("size").alias("whole"))
            sizes = open_.filter("grown AND settled < n").select("root", "n", "whole")
        blocks = F.ceil(F.greatest(F.col("n") / block, F.col("whole") / FULL)).cast("int")
        wanted = stash(groups.join(sizes, "root").select(F.col("node").alias("class"), "root", blocks.alias("blocks")))
        got = stash(verify(sets.join(wanted, "class"), similarity, level))
        if found is not None:
            old, found = found, stash(found.join(wanted.select("class"), "class", "left_anti").union(got))
            discard(old, got, known)
        else:
            found = got
        discard(wanted)
    discard(groups)
    return found


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, group_id, n_links of documents with columns doc_id and text, one row each.

    class_id: the smallest id among texts with the same shingles. group_id: the smallest id among those that
    links connect. n_links: how many other rows have a similarity of at least ``similarity``."""
    levels = levels_for(similarity, recall)
    signed = stash(sign(docs, n))
    full = stash(signed.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"), F.first("signature").alias("signature")))
    rows, classes = stash(signed.select("doc_id", "class")), stash(full.drop("signature"))
    discard(signed)  # signatures are most of it
    ties = tie(full.select("class", "signature"), levels)
    discard(full)
    tied = ties.select(F.col("a").alias("class")).union(ties.select("b")).distinct()
    wanted = stash(tied.join(classes.select("class", "class_id", "members"), "class"))
    # the rows with the smallest ids of candidate classes bring the texts; whatever else comes falls out in the join
    sets = stash(shingle_sets(docs, wanted.select("class_id"), n).join(wanted.select("class", "members"), "class"))
    found = climb(ties, sets, similarity, recall, levels, block)
    discard(sets, ties, wanted)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("class").alias("a"), F.col("tie").alias("b")))
    names = classes.select(F.col("class").alias("node"), "class_id")
    grouped = parts.join(names, "node").select("root", "class_id").union(parts.select("root").distinct().join(names.withColumnRenamed("node", "root"), "root"))
    least = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    labels = parts.union(parts.select(F.col("root").alias("node"), "root").distinct()).join(least, "root").select(F.col("node").alias("class"), "group_id")
    # written, so that the last join has a plain shuffle on both sides and Spark can split a class with many members
    whole = stash(classes.select("class", "class_id", "members").join(links, "class", "left").join(labels, "class", "left"))
    rows = rows.join(whole, "class", "left")
    alone = F.col("class").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("group_id", "class_id")).alias("group_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("members") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
    )


def query(spark, sf_dir):
    return join(only(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
