"""A hidden Markov language model that scores whole texts.

Tokens are lower-cased words and one end. A state emits a token's class, and the class emits the token: the
OWN most frequent words are classes of their own, all others fall into RARE classes by a hash, within which
a word has (c + 1) / (n + v + 1) of n training tokens and v distinct words, the last share being that of
any unseen word. States are trained by Baum-Welch: WARM passes over a part each (expected counts under the
latest parameters, added to the halved counts so far) only bring the states apart; then FULL iterations follow,
each with the expected counts of all training documents under one set of parameters, and nothing else in the
next, so that every training document counts alike. A class gets one more token, dealt to the states as all
tokens are, so that what was seen a few times is not fitted to one state. Scoring is the scaled forward recursion: exact sequence
likelihood, no sampling, no cut texts.

Plan: word counts are summed map-side and by shuffle over all training documents. The TOP most frequent words
are broadcast with their counts, words of over LONG bytes by a digest: a fixed bound. Documents are turned
into numbers once and written: class numbers, two bytes a token, and the other distinct words; an iteration
and the scoring read those and no text. For scoring, a document is a head row and one row for each of its
other words, which get their counts by a shuffled join on the word; such words are rare by choice, so no key
is hot. Documents of like length run side by side as arrays, longest first. What returns to the driver is
(OWN + RARE) x STATES sums an iteration.

Cases: null and empty texts are the end alone; ids may repeat or be null: equal rows are scored once and
returned as often as they stand; an id that is null is not held out; without training tokens base_score
and score are both 0; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches, frugal, held_out, only, read, stash, texts

STATES, OWN, RARE, TOP, LONG, WARM, FULL, KEEP, SEED = 8, 8192, 4096, 200_000, 64, 2, 2, 0.5, 7
#: Tokens that are handled side by side, and the lengths at which documents part ways.
TOGETHER, LENGTHS = 1 << 20, (600, 2400, 9600)
#: Letters of text after which a task passes on the words that it has counted.
FLUSH = 32 << 20
END = ""


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, c of documents with a column text; the end is the word ''."""

    def run(source):
        held: Counter = Counter()
        size = 0
        for batch in batches(source):
            for text in texts(batch.column(0)):
                held.update(tokens(text))
                held[b""] += 1
                size += len(text)
            if len(held) > 500_000 or size > FLUSH:
                yield table(held)
                held.clear()
                size = 0
        yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(frugal(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def short(word: bytes) -> bytes:
    """What stands for a word of over LONG bytes; no token has a space."""
    return b" " + hashlib.md5(word).hexdigest().encode()


class Vocabulary:
    """The most frequent words as (word or what is short for it, count, crc32), the classes, and how many tokens
    and words each rare class has."""

    def __init__(self, words: list[tuple[str, int, int]], tokens: int, distinct: int, rare: dict[int, tuple[int, int]], own: int = OWN):
        self.own = own
        words = sorted((x for x in words if x[0] != END), key=lambda x: (-x[1], x[0]))
        self.total, self.distinct = tokens, distinct
        self.index = {w.encode(): i for i, (w, _, _) in enumerate(words)}
        self.c = np.array([c for _, c, _ in words], dtype=np.int64)
        self.classes = np.array([1 + i if i < own else 1 + own + crc % RARE for i, (_, _, crc) in enumerate(words)], dtype=np.int32)
        self.n, self.v = np.zeros(RARE), np.zeros(RARE)
        for k, (n, v) in rare.items():
            self.n[k], self.v[k] = n, v
        for _, c, crc in words[:own]:
            self.n[crc % RARE] -= c
            self.v[crc % RARE] -= 1
        emit = np.log10((self.c + 1) / (self.n + self.v + 1)[np.maximum(self.classes - 1 - own, 0)])
        self.emit = np.where(self.classes <= own, 0.0, emit)
        self.base = np.log10((self.c + 1) / self.whole)

    @property
    def whole(self) -> int:
        return self.total + self.distinct + 1

    def rare_class(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word) % RARE

    def lookup(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        at = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(at < 0).tolist():  # long words are there by what is short for them only
            if len(words[i]) > LONG:
                at[i] = get(short(words[i]), -1)
        return at

    def class_of(self, words: list[bytes], at: np.ndarray) -> np.ndarray:
        """The classes of the words and of the end."""
        out = np.zeros(len(words) + 1, np.int32)
        if len(words):
            known = at >= 0
            out[:-1][known] = self.classes[at[known]]
            rest = np.flatnonzero(~known)
            first = 1 + self.own
            out[rest] = [first + zlib.crc32(words[i]) % RARE for i in rest.tolist()]
        return out


def learn_vocabulary(counts: DataFrame, top: int = TOP, own: int = OWN) -> tuple[Vocabulary, int]:
    """counts: word, c, stashed. Also how often the end stands."""
    of = F.crc32(F.col("word").cast("binary")) % RARE
    level = F.floor(F.log2("c") * 8)
    rows = counts.groupBy(of.alias("of"), (F.col("word") == END).alias("end")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    real = counts.filter(F.col("word") != END)
    room, least = top, None
    for r in sorted(real.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["level"]):
        room -= r["v"]
        if room < 0:
            break
        least = r["level"]
    key = F.when(F.octet_length("word") <= LONG, F.col("word")).otherwise(F.concat(F.lit(" "), F.md5(F.col("word").cast("binary"))))
    frequent = real.filter(level >= least).select(key.alias("key"), "c", F.crc32(F.col("word").cast("binary")).alias("crc")) if least is not None else None
    words = [] if frequent is None else [tuple(r) for r in frequent.collect()]
    rare = {r["of"]: (r["n"], r["v"]) for r in rows if not r["end"]}
    ends = sum(r["n"] for r in rows if r["end"])
    return Vocabulary(words, sum(r["n"] for r in rows), sum(r["v"] for r in rows), rare, own), ends


class Lanes:
    """Sequences of classes side by side, longest first; what is active at step t lies at at[t]:at[t + 1]."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        active = np.searchsorted(-lengths[self.order], -np.arange(lengths.max()), side="left")
        self.at = np.concatenate([[0], np.cumsum(active)])
        self.classes = np.empty(self.at[-1], np.int32)
        for lane, i in enumerate(self.order.tolist()):
            self.classes[self.at[: lengths[i]] + lane] = sequences[i]

    def steps(self):
        return [slice(a, b) for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]


class Model:
    """start [k], move [k, k], emit [class, k]."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, unigrams: np.ndarray):
        """Sticky states that differ by seeded noise."""
        r = np.random.default_rng(SEED)
        emit = unigrams[:, None] * np.exp(r.normal(size=(len(unigrams), STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def of(cls, start, move, emit, unigrams: np.ndarray):
        """From expected counts, with one more token of each class that they hold, dealt to the states as all
        tokens are, so that a class seen a few times hardly tells them apart; a little of the unigrams keeps
        every class possible."""
        mass = emit.sum(axis=0)
        dealt = np.minimum(emit.sum(axis=1), 1)[:, None] * mass / max(mass.sum(), 1e-9)
        emit = emit + dealt + 1e-3 * unigrams[:, None] * mass + 1e-9
        start, move = start + 1e-3, move + 1e-3
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, lanes: Lanes) -> tuple[np.ndarray, np.ndarray]:
        """The scale of each active cell, and the scaled forward variables."""
        alphas, scale, ones, last = np.take(self.emit, lanes.classes, axis=0), np.empty(len(lanes.classes)), np.ones(len(self.start)), None
        for s in lanes.steps():
            alpha = alphas[s]
            alpha *= self.start if last is None else last[: len(alpha)] @ self.move
            c = np.matmul(alpha, ones, out=scale[s])
            alpha /= c[:, None]
            last = alpha
        return scale, alphas

    def log10(self, lanes: Lanes) -> np.ndarray:
        """The log10 likelihood of each sequence, in the order in which they were given."""
        logs, sums = np.log10(self.forward(lanes)[0]), np.zeros(len(lanes.order))
        for s in lanes.steps():
            sums[: s.stop - s.start] += logs[s]
        out = np.empty_like(sums)
        out[lanes.order] = sums
        return out

    def expected(self, lanes: Lanes):
        """Expected counts of starts, moves and emissions."""
        scale, alphas = self.forward(lanes)
        ahead, betas, steps = np.take(self.emit, lanes.classes, axis=0), np.ones_like(alphas), lanes.steps()
        ahead /= scale[:, None]
        back = np.ascontiguousarray(self.move.T)
        for before, s in zip(steps[-2::-1], steps[:0:-1], strict=True):
            x = ahead[s]
            x *= betas[s]
            np.matmul(x, back, out=betas[before.start : before.start + len(x)])
        first, move = steps[0].stop, np.zeros_like(self.move)
        came = np.arange(first, len(alphas)) - np.repeat(np.diff(lanes.at)[:-1], np.diff(lanes.at)[1:])  # the same lane, a step before
        for k in range(0, len(came), 1 << 14):
            part = came[k : k + (1 << 14)]
            move += alphas[part].T @ ahead[first + k : first + k + len(part)]
        alphas *= betas  # now the posterior
        emit = np.stack([np.bincount(lanes.classes, alphas[:, k], len(self.emit)) for k in range(len(self.start))], axis=1)
        return alphas[steps[0]].sum(axis=0), move * self.move, emit


def together(items, most: int = TOGETHER):
    """Lists of items (length, ...) of like length, with about so many tokens each."""
    held, sizes = [[] for _ in range(len(LENGTHS) + 1)], [0] * (len(LENGTHS) + 1)
    for item in items:
        k = sum(item[0] > n for n in LENGTHS)
        held[k].append(item)
        sizes[k] += item[0]
        if sizes[k] >= most:
            yield held[k]
            held[k], sizes[k] = [], 0
    yield from filter(None, held)


def encode(docs: DataFrame, vocabulary: Vocabulary, ends: int, shards: int) -> DataFrame:
    """docs (doc_id, held_out, text) as numbers, one row each: doc_id, held_out; key, equal for equal rows;
    shard, dealt in turn; classes, the class numbers of all tokens; n_tokens; and of the tokens that are among
    the top words n_known, base and model, what they add to both scores; rest, the other words and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = float(np.log10((ends + 1) / vocabulary.whole))
    rest_type = pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())]))

    def run(source):
        v, n = shared.value, 0
        for batch in batches(source):
            classes, sizes, known, base, model, words_, tfs, ends_at = [], [], [], [], [], [], [], [0]
            for text in texts(batch.column(2)):
                words = tokens(text)
                at = v.lookup(words)
                top, rest = at[at >= 0], Counter([words[k] for k in np.flatnonzero(at < 0).tolist()])
                classes.append(v.class_of(words, at).astype("<u2").tobytes())
                sizes.append(len(words) + 1)
                known.append(len(top) + (ends > 0))
                base.append(end + float(v.base[top].sum()))
                model.append(float(v.emit[top].sum()))
                words_ += [w.decode("utf-8", "replace") for w in rest]
                tfs += rest.values()
                ends_at.append(len(tfs))
            pairs = pa.StructArray.from_arrays([pa.array(words_, pa.string()), pa.array(tfs, pa.int64())], ["word", "tf"])
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array((n + np.arange(len(sizes))) % shards, pa.int32()), pa.array(classes, pa.binary())]
            columns += [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs).cast(rest_type)], [x.split()[0] for x in ENCODED.split(", ")])
            n += len(sizes)

    assert 1 + vocabulary.own + RARE <= 1 << 16
    keyed = docs.select("doc_id", "held_out", "text", F.xxhash64("text", "held_out").alias("key"))
    return keyed.mapInArrow(frugal(run), ENCODED)


ENCODED = "doc_id long, held_out boolean, key long, shard int, classes binary, n_tokens long, n_known long, base double, model double, rest array<struct<word:string,tf:long>>"


def train(encoded: DataFrame, vocabulary: Vocabulary, ends: int, warm: int = WARM, full: int = FULL) -> Model:
    """encoded: shard, classes, only of those that may teach."""
    own = vocabulary.own
    unigrams = np.zeros(1 + own + RARE)
    unigrams[0] = ends
    np.add.at(unigrams, vocabulary.classes[:own], vocabulary.c[:own])
    unigrams[1 + own :] = vocabulary.n
    unigrams = (unigrams + 1) / (unigrams + 1).sum()
    model, sc = Model.begin(unigrams), encoded.sparkSession.sparkContext
    names = [f"s{k}" for k in range(STATES)]

    def counted(part: DataFrame, model: Model) -> np.ndarray:
        """Expected counts of starts, moves and emissions of these documents, one below the other."""
        now = sc.broadcast(model)

        def step(source):
            m, sums = now.value, None
            items = ((len(x) // 2, x) for batch in batches(source) for x in batch.column(0).to_pylist())
            for held in together(items, TOGETHER // 2):  # training holds three arrays of them, scoring one
                got = m.expected(Lanes([np.frombuffer(x, "<u2").astype(np.int32) for _, x in held]))
                sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
            if sums is not None:
                flat = np.concatenate([sums[0][None], sums[1], sums[2]])
                at = np.flatnonzero(flat.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(flat[at, k]) for k in range(STATES))], ["row", *names])

        sums = part.select("classes").mapInArrow(frugal(step), "row int, " + ", ".join(f"{k} double" for k in names))
        got = sums.groupBy("row").agg(*(F.sum(k).alias(k) for k in names)).toPandas()
        flat = np.zeros((1 + STATES + len(unigrams), STATES))
        flat[got["row"].to_numpy(dtype=int)] = got[names].to_numpy()
        return flat

    of = lambda x: Model.of(x[0], x[1 : 1 + STATES], x[1 + STATES :], unigrams)
    so_far = np.zeros((1 + STATES + len(unigrams), STATES))
    for shard in range(warm):
        so_far = KEEP * so_far + counted(encoded.filter(F.col("shard") == shard), model)
        model = of(so_far)
    for _ in range(full):
        model = of(counted(encoded, model))
    return model


HEAD = "doc_id long, held_out boolean, key long, word string, tf long, heads int, n_tokens long, n_known long, base double, model double"


def score(encoded: DataFrame, counts: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """encoded: as encode gives it, stashed."""
    sc = encoded.sparkSession.sparkContext
    learned, trained = vocabulary.total > 0, sc.broadcast(model)

    def run(source):
        m = trained.value

        def items():
            for batch in batches(source):
                yield from ((len(x[3]) // 2, *x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))

        for held in together(items()):
            logs = m.log10(Lanes([np.frombuffer(x[4], "<u2").astype(np.int32) for x in held])) if learned else np.zeros(len(held))
            n = len(held)
            ids, out, keys, _, known, base, emit = zip(*(x[1:] for x in held), strict=True)
            words = [f" {i} {k}" for i, k in zip(ids, keys, strict=True)]  # no token has a space: such a row finds no count
            columns = (ids, out, keys, words, [0] * n, [1] * n, [x[0] for x in held], known, base, (logs + np.array(emit)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    heads = encoded.select("doc_id", "held_out", "key", "classes", "n_known", "base", "model").mapInArrow(frugal(run), HEAD)
    others = encoded.select("doc_id", "held_out", "key", F.inline("rest"))
    zero = {"heads": F.lit(0), "n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base": F.lit(0.0), "model": F.lit(0.0)}
    seen = heads.union(others.withColumns(zero).select(*NAMES))
    whole = pd.DataFrame({"of": np.arange(RARE), "class_whole": vocabulary.n + vocabulary.v + 1})
    known = counts.withColumnsRenamed({"word": "counted", "c": "seen"}).hint("shuffle_hash")
    rows = seen.join(known, F.col("word") == F.col("counted"), "left")
    rows = rows.join(F.broadcast(encoded.sparkSession.createDataFrame(whole, "of int, class_whole double")), F.crc32(F.col("word").cast("binary")) % RARE == F.col("of"))
    c = F.coalesce(F.col("seen"), F.lit(0))
    total = rows.groupBy("doc_id", "held_out", "key").agg(
        F.sum("heads").alias("heads"),
        F.sum("n_tokens").alias("head_tokens"),
        F.sum("tf").alias("rest_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * F.log10((c + 1) / F.lit(float(vocabulary.whole)))).alias("base"),
        F.sum(F.col("model") + F.col("tf") * F.log10((c + 1) / F.col("class_whole"))).alias("model"),
    )
    each = lambda x: F.col(x) / F.col("heads")  # noqa: E731  equal rows are summed together
    one = total.select(
        "doc_id",
        "held_out",
        each("head_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        each("base").alias("base_score"),
        F.when(F.lit(learned), each("model")).otherwise(0.0).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("heads").cast("int"))).alias("copy"),
    )
    return one.drop("copy")


NAMES = [x.split()[0] for x in HEAD.split(", ")]
TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def score_all(docs: DataFrame, top: int = TOP, own: int = OWN) -> DataFrame:
    """docs: doc_id, held_out, text; learns from those not held out."""
    teach = docs.filter("NOT held_out")
    counts = stash(count_tokens(teach))
    vocabulary, ends = learn_vocabulary(counts, top, own)
    encoded = stash(encode(docs, vocabulary, ends, max(1, WARM)))
    return score(encoded, counts, vocabulary, train(encoded.filter("NOT held_out"), vocabulary, ends))


def query(spark, sf_dir):
    return score_all(only(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text").withColumn("held_out", held_out("doc_id", 7, 2)))
