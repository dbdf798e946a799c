import random

from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import mixing

SCHEMA = "doc_id long, source string, text string"


@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([1.0, 2.0, 3.0])), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_targets_share_everything_and_stop_at_the_cap(x):
    sizes, weights = [n for n, _ in x], [w for _, w in x]
    got = mixing.targets(sizes, weights)
    assert abs(sum(got) - sum(sizes)) < 1e-6 and all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes, strict=True))
    free = [t / w for t, w, n in zip(got, weights, sizes, strict=True) if t < 3 * n - 1e-9]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def corpus(n, seed=0):
    r = random.Random(seed)
    return [(i, r.choice(["a", "b", "c", "c", "c", "d", None]), r.choice([None, "", "x"]) if r.random() < 0.1 else "w " * r.randint(1, 60)) for i in range(n)]


def test_words_taken(spark):
    rows = corpus(400)
    rows += rows[:5] + [(None, "a", "some words here"), (None, "a", "some words here")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    sizes, took = {}, {}
    for g in got:
        assert 0 <= g.taken <= 3 * g["size"]
        sizes[g.source] = sizes.get(g.source, 0) + g["size"]
        took[g.source] = took.get(g.source, 0) + g.taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in order], [1.0 + i % 3 for i in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(took[s] - t) <= max(5, 0.01 * t)
    assert {(g.source, g.source_size) for g in got} == set(sizes.items())
    again = mixing.taken(df.repartition(7)).collect()
    key = lambda g: tuple(map(str, g))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_is_even_from_the_start(spark):
    goals = [100.0, 200.0, 300.0, 0.0]
    rows = mixing.schedule(spark, goals, 1).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(600))
    seen = [0] * 4
    for r in rows:
        assert r.rank == seen[r.k]
        seen[r.k] += 1
        assert all(abs(n - g / 600 * (r.slot + 1)) < 4 for n, g in zip(seen, goals, strict=True))


def test_slots_and_documents_agree(spark):
    assignment, placed, _ = mixing.mix(spark.createDataFrame(corpus(120, 3), SCHEMA), block=16, slots=50)
    got: dict = {}
    for r in assignment.collect():
        assert 0 <= r.start and r.words > 0
        got.setdefault(r.slot, []).append(r.words)
    assert max(map(sum, got.values())) <= 16  # no slot holds more than a block


def test_empty_tables(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.taken(spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)).collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
