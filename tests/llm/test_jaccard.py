import random

import numpy as np
import pytest
from millrace.llm import jaccard


def sets(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(docs):
    """n_links and group by position."""
    s = [sets(t) for _, t in docs]
    links, root = [0] * len(docs), list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = [find(i) for i in range(len(docs))]
    least = {g: min((docs[i][0] for i in range(len(docs)) if groups[i] == g and docs[i][0] is not None), default=-1) for g in groups}
    return sorted((-1 if d is None else d, links[i], least[groups[i]]) for i, (d, _) in enumerate(docs))


def corpus(seed, families=12, copies=14, words=120):
    r, out = random.Random(seed), []
    for f in range(families):
        base = [f"w{r.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, 9)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 10**6)}"
            out.append(" ".join(t))
        out.append(out[-1])
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [192, 4])
def test_links_and_groups_equal_brute_force(spark, block):
    docs = corpus(5) + [(9000, None), (9001, ""), (9002, "a b"), (9003, " a\tb\n"), (None, "a b"), (9004, "a b c d e"), (9002, "a b")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, members int, class string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links, -1 if r.group_id is None else r.group_id) for r in jaccard.join(df, block=block).collect())
    assert got == brute(docs)


def test_empty_table_and_texts_without_links(spark):
    schema = "doc_id long, text string"
    assert jaccard.join(spark.createDataFrame([], schema)).count() == 0
    rows = jaccard.join(spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six")], schema)).collect()
    assert sorted((r.doc_id, r.class_id, r.group_id, r.n_links) for r in rows) == [(1, 1, 1, 0), (2, 2, 2, 0), (3, 3, 3, 0)]


def test_ids_that_different_texts_share(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = jaccard.join(spark.createDataFrame([(1, a), (1, b), (2, a + " c"), (3, b + " c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_links) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_depth_reaches_the_recall():
    d = jaccard.depth_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES


def test_chains_join(spark):
    ties = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(ties).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert jaccard.components(ties.limit(0)).count() == 0


def test_exact_counts_at_the_threshold():
    b = jaccard.Bunch()
    b.names, b.members = ["a", "b", "c"], [1, 1, 1]
    b.sets = [np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64)]
    linked, alike = jaccard.compare(b, True, 0.8)  # 8 of 10, 7 of 11
    assert linked.tolist() == [[False, True, False], [True, False, True], [False, True, False]]
    assert alike[0, 1:].tolist() == [0.8, 7 / 11]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_walk_ties_what_shares_a_prefix(spark, parts):
    """Ties of the sorted tries connect exactly the classes that share a prefix in some tree, at each level,
    however the sorted rows are cut into tasks."""
    r, levels = np.random.default_rng(parts), [10, 8, 6]
    keys = r.integers(0, 2, (300, 3, 10)).astype(">u2")
    keys[:60, 1] = keys[0, 1]  # a prefix that many have
    rows = [(bytes([i // 256, i % 256]), [k.tobytes() for k in x]) for i, x in enumerate(keys)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        ties = [(x.level, bytes(x.a), bytes(x.b)) for x in jaccard.tie(spark.createDataFrame(rows, "class binary, signature array<binary>"), levels).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for level in levels:
        assert parts_of([(a, b) for x, a, b in ties if x >= level]) == parts_of([(p[0], q[0]) for n, p in enumerate(rows) for q in rows[:n] if any(u[: 2 * level] == v[: 2 * level] for u, v in zip(p[1], q[1], strict=True))])


def parts_of(ties):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in ties:
        root[find(a)] = find(b)
    out: dict = {}
    for x in root:
        out.setdefault(find(x), set()).add(x)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def test_longer_prefixes_settle_documents_with_close_copies():
    assert jaccard.missed(np.array([0.99]), 10)[0] < 1 - jaccard.RECALL < jaccard.missed(np.array([0.8]), 10)[0]
    assert jaccard.missed(np.array([0.8]), jaccard.levels_for(0.8, jaccard.RECALL)[-1])[0] < 1 - jaccard.RECALL


def test_ids_of_any_type(spark):
    a = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([((2, "x"), a), ((1, "y"), a + " c"), ((None, "z"), "b"), ((1, "a"), a)], "doc_id struct<i:long,h:string>, text string")
    got = sorted((str(r.doc_id.h), str(r.class_id.h), str(r.group_id.h), r.n_links) for r in jaccard.join(df).collect())
    assert got == [("a", "a", "a", 2), ("x", "a", "a", 2), ("y", "y", "a", 2), ("z", "z", "z", 0)]


def test_what_a_task_remembers_is_bounded_in_bytes():
    known = jaccard.Hashes(most=20_000)
    for i in range(50):
        words = [f"{i}w{j}".encode() for j in range(40)] * 2
        assert known(words).tolist() == jaccard.Hashes()(words).tolist()
        assert known.size <= 20_000 and len(known.of) < 200
