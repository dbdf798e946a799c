"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary that are lower-case letters. A word is a space mark and
its letters; its probability in a language is the sum over all ways to cut it into pieces of the product of
that language's piece probabilities, by the forward algorithm. A text's score is the product over its words
and the language's share of the learned texts, normalised over languages. A letter that is no piece of its
own has a fixed small probability in every language.

Learning: words are counted by language in every text that may teach, map-side before the shuffle, so each
distinct word is worked on once a pass; ROUNDS passes of expectation-maximisation over those counts follow.
What returns to the driver is one number a piece and language, bounded by the vocabulary.

Prediction is one pass without a shuffle; a task keeps the scores of words in at most REMEMBER bytes. Words
are handled together by length as arrays: probabilities of all cuts are computed for thousands of words at
once. The sum runs over every segmentation into pieces of any length that the vocabulary has; for words of
over LONGEST letters it is rescaled at each letter, so that no length underflows.

Cases: a null text or one without letters is ``und`` with score 0, as is all where nothing was learned;
words of any length are scored whole; ties go to the language first by code
point; repeated rows are predicted alike; null languages teach nothing; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm.common import Bounded, batches, frugal, held_out, only, read, stash

LONGEST, ROUNDS, ALPHA, UNKNOWN, REMEMBER, AT_ONCE, TINY = 24, 3, 0.01, 1e-6, 64 << 20, 4096, 1e-300
WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Letters of text after which a task passes on the words that it has counted.
FLUSH = 32 << 20
UNDECIDED = "und"
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Finds, for many words of one length, the number of the piece at each start and length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i) for i in range(model.vocab_size())}
        self.pieces = sorted(p for p in found if p == MARK or (b := p.removeprefix(MARK)).isalpha() and b == b.lower())
        self.count, self.longest = len(self.pieces), max(map(len, self.pieces), default=1)
        self.keys = np.array([self.hash(np.array([[ord(c) for c in p]]))[0] for p in self.pieces], dtype=np.uint64)
        self.first, self.second = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
        taken = set()
        for i, key in enumerate(self.keys.tolist()):
            at = key >> 44
            (self.second if at in taken else self.first)[(key >> 20) & 0xFFFFF if at in taken else at] = i
            taken.add(at)
        assert (self.find(self.keys) == np.arange(self.count)).all()

    @staticmethod
    def step(h, c):
        return (h ^ c.astype(np.uint64)) * FACTOR + (h >> np.uint64(29))

    def hash(self, codes):
        h = np.full(len(codes), 7, np.uint64)
        for j in range(codes.shape[1]):
            h = self.step(h, codes[:, j])
        return h

    def find(self, h):
        """The piece's number, or ``count`` for none."""
        a, b = self.first[h >> np.uint64(44)], self.second[(h >> np.uint64(20)) & np.uint64(0xFFFFF)]
        return np.where(self.keys[a] == h, a, np.where(self.keys[b] == h, b, self.count))

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """The code points of words of one length."""
        return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)

    def row(self, codes: np.ndarray, i: int) -> list[np.ndarray]:
        """At l - 1: the pieces of length l at i. A lone letter that is no piece is count + 1."""
        h, row = np.full(len(codes), 7, np.uint64), []
        for j in range(i, min(codes.shape[1], i + self.longest)):
            h = self.step(h, codes[:, j])
            row.append(self.find(h))
        row[0] = np.where(row[0] == self.count, self.count + 1, row[0])
        return row

    def cuts(self, words: list[str]) -> list[list[np.ndarray]]:
        """The rows of every start; words are of one length."""
        codes = self.codes(words)
        return [self.row(codes, i) for i in range(codes.shape[1])]


@functools.lru_cache(maxsize=1)
def pieces_by(path: str) -> Pieces:
    with np.errstate(over="ignore"):
        return Pieces(path)


def by_length(words: list[str]):
    """Index arrays of words of one length, few enough to be handled at once."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        some = max(1, AT_ONCE * LONGEST // max(LONGEST, lengths[group[0]]))
        for i in range(0, len(group), some):
            yield group[i : i + some]


def forward(cuts: list[list[np.ndarray]], table: np.ndarray) -> np.ndarray:
    """alpha[j]: the summed probability of all cuts of the first j letters, by word and language."""
    n, w = len(cuts), len(cuts[0][0])
    alpha = np.zeros((n + 1, w, table.shape[1]))
    alpha[0] = 1
    for i in range(n):
        for length, ids in enumerate(cuts[i], 1):
            alpha[i + length] += alpha[i] * table[ids]
    return alpha


def long_forward(pieces: Pieces, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The logarithms of what forward gives, for words of any length: only as many positions as a piece is long
    are open at a time, and they are scaled anew at each letter."""
    w, n, wide = *codes.shape, pieces.longest + 1
    ring, shift, logs = np.zeros((wide, w, table.shape[1])), np.zeros((w, 1)), np.empty((n + 1, w, table.shape[1]))
    ring[0] = 1
    for i in range(n + 1):
        here = ring[i % wide]
        logs[i] = np.log(np.maximum(here, TINY)) + shift
        if i < n:
            top = here.max(axis=1, keepdims=True)
            ring /= top
            shift = shift + np.log(top)
            for length, ids in enumerate(pieces.row(codes, i), 1):
                ring[(i + length) % wide] += here * table[ids]
            here[:] = 0
    return logs


def long_expected(pieces: Pieces, codes: np.ndarray, counts: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece counts of words of any one length to out."""
    logs = long_forward(pieces, codes, table)[:, :, 0]
    w, n, wide = *codes.shape, pieces.longest + 1
    ring, shift = np.zeros((wide, w)), np.zeros(w)
    ring[n % wide] = 1
    for i in range(n - 1, -1, -1):
        here, found = ring[i % wide], []
        here[:] = 0
        for length, ids in enumerate(pieces.row(codes, i), 1):
            found.append((ids, table[ids, 0] * ring[(i + length) % wide]))
            here += found[-1][1]
        share = counts * np.exp(logs[i] + shift - logs[n])
        for ids, x in found:
            np.add.at(out, ids, x * share)
        top = here.copy()
        ring /= top
        shift += np.log(top)


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Expected piece counts of words with these counts, in the language of the one column of table."""
    out = np.zeros(pieces.count + 2)
    for group in by_length(words):
        some = [words[i] for i in group]
        if len(some[0]) > LONGEST:
            long_expected(pieces, pieces.codes(some), counts[group], table, out)
            continue
        cuts = pieces.cuts(some)
        alpha, n = forward(cuts, table)[:, :, 0], len(cuts)
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            for length, ids in enumerate(cuts[i], 1):
                beta[i] += table[ids, 0] * beta[i + length]
        share = counts[group] / alpha[n]
        flat = [(ids, alpha[i] * share * table[ids, 0] * beta[i + length]) for i in range(n) for length, ids in enumerate(cuts[i], 1)]
        out += np.bincount(np.concatenate([x for x, _ in flat]), np.concatenate([x for _, x in flat]), len(out))
    return out


class Model:
    def __init__(self, path: str, langs: list[str], prior: np.ndarray, table: np.ndarray):
        self.path, self.langs, self.prior, self.table = path, langs, prior, table

    def words(self, words: list[str]) -> np.ndarray:
        """The log probability of each word, with its mark, in each language."""
        pieces, out = pieces_by(self.path), np.zeros((len(words), len(self.langs)))
        with np.errstate(over="ignore"):
            for group in by_length(words):
                some = [words[i] for i in group]
                if len(some[0]) > LONGEST:
                    out[group] = long_forward(pieces, pieces.codes(some), self.table)[-1]
                else:
                    out[group] = np.log(np.maximum(forward(pieces.cuts(some), self.table)[-1], TINY))
        return out

    def predict(self, texts: list[str], known: Known) -> list[tuple[str, float]]:
        split = [WORD.findall(t.lower()) for t in texts]
        known.learn(set().union(*split), lambda new: self.words([MARK + w for w in new]))
        row, out = known.row.of.__getitem__, []
        for words in split:
            if not self.langs or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
                out.append((UNDECIDED, 0.0))
                continue
            x = known.scores[np.fromiter(map(row, words), np.int64, len(words))].sum(axis=0) + self.prior
            best = int(np.argmax(x))
            out.append((self.langs[best], float(1 / np.exp(x - x[best]).sum())))
        return out


class Known:
    """The scores of the words that a task has met."""

    def __init__(self, langs: int, most: int = REMEMBER):
        self.row, self.scores, self.langs = Bounded(200 + 16 * langs, most), np.zeros((0, langs)), langs

    def learn(self, words: set[str], score) -> None:
        new = list(words.difference(self.row.of))
        if new and self.row.room(new):
            new = list(words)
            self.row.room(new)
        if new:
            n = len(self.row.of)
            if n + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores[:n], np.zeros((n + 2 * len(new), self.langs))])
            self.scores[n : n + len(new)] = score(new)
            self.row.of.update(zip(new, range(n, n + len(new)), strict=True))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n of documents with columns lang and text; texts a language has are counted under the word ''."""

    def run(source):
        held: Counter = Counter()
        size = 0
        for batch in batches(source):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[lang, ""] += 1
                size += len(text or "")
                for word, n in Counter(WORD.findall((text or "").lower())).items():
                    held[lang, word] += n
            if len(held) > 400_000 or size > FLUSH:
                yield table(held)
                held.clear()
                size = 0
        yield table(held)

    def table(held):
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(frugal(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gathered(frames, rows: int = 200_000):
    """Larger frames, so that words of one length are many."""
    held: list = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def fit(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """docs: lang, text, only those that may teach."""
    path = path or default_vocabulary()
    counts = stash(count_words(docs.filter("lang IS NOT NULL")))
    seen = sorted((r["lang"], r["n"]) for r in counts.filter("word = ''").select("lang", "n").collect())
    langs = [x for x, _ in seen]
    prior = np.log(np.array([n for _, n in seen], dtype=float) / max(1, sum(n for _, n in seen)))
    count = pieces_by(path).count
    table = np.full((count + 2, len(langs)), 1.0 / (count or 1))
    table[count], table[count + 1] = 0, UNKNOWN
    for _ in range(rounds if langs else 0):

        def step(frames, table=table):
            pieces, sums = pieces_by(path), np.zeros((len(langs), count + 2))
            for f in gathered(frames):
                for lang, g in f.groupby("lang"):
                    k = langs.index(lang)
                    with np.errstate(over="ignore"):
                        sums[k] += expected(pieces, [MARK + w for w in g["word"]], g["n"].to_numpy(dtype=float), table[:, [k]])
            k, piece = np.nonzero(sums[:, :count])
            yield pd.DataFrame({"k": k.astype("int32"), "piece": piece.astype("int32"), "n": sums[k, piece]})

        got = counts.filter("word != ''").mapInPandas(frugal(step), "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.full((count + 2, len(langs)), ALPHA)
        table[got["piece"].to_numpy(), got["k"].to_numpy()] += got["n"].to_numpy()
        table[count:] = 0
        table /= table.sum(axis=0)
        table[count + 1] = UNKNOWN
    return Model(path, langs, prior, table)


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """lang_pred, score of documents with a column text, after the columns to carry."""

    def run(source):
        known = Known(len(model.langs))
        for batch in batches(source):
            said = model.predict([t or "" for t in batch.column(0).to_pylist()], known)
            columns = [*batch.columns[1:], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "lang_pred", "score"])

    said = StructType([*(docs.schema[c] for c in carry), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(F.col("text").alias("__text"), *carry).mapInArrow(frugal(run), said)


def query(spark, sf_dir):
    docs = only(read(spark, sf_dir, "documents"), doc_id="doc_id", lang="lang", text="text").withColumn("held_out", held_out("doc_id", 4, 2))
    return predict(docs, fit(docs.filter("NOT held_out")), "doc_id", "held_out")
