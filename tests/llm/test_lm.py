import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from millrace.llm import hmm
from millrace.llm.common import held_out
from pyspark.sql import functions as F

DOCS = [(i, f"The cat {'sat' if i % 3 else 'ran'} on mat{i % 5} É x") for i in range(40)] + [(40, None), (41, ""), (42, "UNSEEN words here here"), (42, "UNSEEN words here here"), (None, "the cat")]


def test_forward_sums_all_state_paths():
    r = np.random.default_rng(0)
    k, c = 3, 5
    start, move, emit = r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(c), k).T
    sequences = [np.array(s) for s in ([1, 2, 0], [3, 0], [0], [4, 4, 4, 1, 0])]
    got = hmm.Model(start, move, emit).log10(hmm.Lanes(sequences))
    for s, x in zip(sequences, got, strict=True):
        total = 0
        for path in product(range(k), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for a, b, w in zip(path, path[1:], s[1:], strict=False):
                p *= move[a, b] * emit[w, b]
            total += p
        assert abs(x - math.log10(total)) < 1e-9


def test_expected_counts_sum_and_raise_the_likelihood():
    r = np.random.default_rng(1)
    sequences = [np.append(r.integers(1, 6, r.integers(1, 30)), 0) for _ in range(50)]
    lanes, flat = hmm.Lanes(sequences), np.full(6, 1 / 6)
    m = hmm.Model.begin(flat)
    before = m.log10(lanes).sum()
    for _ in range(3):
        start, move, emit = m.expected(lanes)
        assert abs(start.sum() - 50) < 1e-6 and abs(emit.sum() - sum(map(len, sequences))) < 1e-6
        assert abs(move.sum() - sum(len(s) - 1 for s in sequences)) < 1e-6
        m = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
        now = m.log10(lanes).sum()
        assert now >= before - 1e-9
        before = now


@pytest.mark.parametrize("top,own", [(200_000, 8192), (3, 2)])
def test_base_scores_and_rows(spark, top, own):
    df = spark.createDataFrame([(*d, "w") for d in DOCS], "doc_id long, text string, word string").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    rows = hmm.score_all(df, top, own).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in DOCS if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in DOCS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 for r in rows)
    seen = [r for r in rows if r.n_tokens > 5]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_words_of_a_rare_class_share_its_probability():
    v = hmm.Vocabulary([("a", 3, zlib.crc32(b"a"))], 10, 4, {})
    assert v.whole == 15 and v.class_of([b"a", b"zz"], v.lookup([b"a", b"zz"])).tolist() == [1, v.rare_class(b"zz"), 0]


def test_empty_table_and_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string").withColumn("held_out", F.lit(False))
    assert hmm.score_all(empty).count() == 0
    none = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    assert [(r.train_tokens, r.base_score, r.score, r.n_known) for r in hmm.score_all(none).collect()] == [(0, 0.0, 0.0, 0)]


def test_frequent_words_of_many_bytes_are_top_words(spark):
    long = "x" * 300
    df = spark.createDataFrame([(i, f"{long} a b{i}") for i in range(30)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    counts = hmm.count_tokens(df)
    v, ends = hmm.learn_vocabulary(counts, top=40)
    assert ends == 30 and v.lookup([long.encode(), b"a"]).min() >= 0 and v.c[v.lookup([long.encode()])[0]] == 30
    rows, n = hmm.score_all(df).collect(), 30 * 4
    want = math.log10(31 / (n + 33 + 1)) * 3 + math.log10(2 / (n + 33 + 1))
    assert all(abs(r.base_score - want) < 1e-9 for r in rows)


def test_training_is_baum_welch_over_all_documents(spark):
    """The model after full iterations equals one process's Baum-Welch on all documents."""
    docs = [(f"the cat {'sat' if i % 3 else 'ran'} on mat{i % 5} " * (1 + i % 4),) for i in range(60)]
    df = spark.createDataFrame(docs, "text string").repartition(5)
    v, ends = hmm.learn_vocabulary(hmm.count_tokens(df), top=100, own=50)
    docs_ = df.select(F.lit(1).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    got = hmm.train(hmm.encode(docs_, v, ends, 1), v, ends, warm=0, full=3)
    unigrams = np.zeros(1 + 50 + hmm.RARE)
    unigrams[0] = ends
    np.add.at(unigrams, v.classes[:50], v.c[:50])
    unigrams[51:] = v.n
    unigrams = (unigrams + 1) / (unigrams + 1).sum()
    want, sequences = hmm.Model.begin(unigrams), []
    for (t,) in docs:
        words = hmm.tokens(t.encode())
        sequences.append(v.class_of(words, v.lookup(words)))
    for _ in range(3):
        want = hmm.Model.of(*want.expected(hmm.Lanes(sequences)), unigrams)
    assert np.allclose(got.move, want.move, rtol=1e-7) and np.allclose(got.emit, want.emit, rtol=1e-7) and np.allclose(got.start, want.start)


def test_documents_of_like_length_run_together():
    items = [(n, i) for i, n in enumerate([1, 5000, 20, 700_000, 3, 4000, 650])]
    groups = list(hmm.together(iter(items)))
    assert sorted(x for g in groups for x in g) == sorted(items)
    assert all(len({sum(n > k for k in hmm.LENGTHS) for n, _ in g}) == 1 for g in groups)


def test_a_class_seen_once_hardly_tells_states_apart():
    emit = np.array([[300.0, 100.0], [1.0, 0.0], [0.0, 0.0]])
    m = hmm.Model.of(np.ones(2), np.ones((2, 2)), emit, np.array([0.9, 0.05, 0.05]))
    assert np.allclose(m.emit.sum(axis=0), 1)
    assert 1 < m.emit[1, 0] / m.emit[1, 1] < 4 and 0.9 < m.emit[2, 0] / m.emit[2, 1] < 1.1
    none = hmm.Model.of(np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), np.full(3, 1 / 3))
    assert np.allclose(none.emit, 1 / 3)
