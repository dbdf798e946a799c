"""Each stage against a plain version of its decision, on one small corpus."""

import random

import corpus_pipeline
import pytest
from millrace.llm import jaccard, linededup

from tests.llm.test_jaccard import sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    en = ["the", "and", "of", "water", "house", "which", "there", "people", "would", "morning", "green", "stone", "river", "under"]
    de = ["der", "und", "von", "wasser", "haus", "welche", "dort", "leute", "würde", "morgen", "grün", "stein", "fluss", "unter"]
    rows = []
    for i in range(160):
        words = (en, de)[i % 2]
        lines = [" ".join(r.choice(words) for _ in range(r.randint(6, 30))) for _ in range(r.randint(1, 4))]
        rows.append((i, "\n".join(["Home and About", *lines] if i % 4 == 0 else lines), ("en", "de")[i % 2], f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(20)]
    rows += [(300 + i, rows[30 + i][1] + " end", rows[30 + i][2], rows[30 + i][3]) for i in range(10)]
    rows += [(400, None, "en", "s0"), (401, "", "de", "s1"), (402, "12 34 !!", None, None), (403, "the water", None, None), rows[3]]
    where = tmp_path_factory.mktemp("sf")
    full = [(a, b, c, d, len(b or ""), "x") for a, b, c, d in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{where}/documents.parquet")
    return str(where)


def run(spark, folder, n):
    """The rows that stage n gets, and those it returns."""
    from millrace.llm.common import read, stash

    docs = read(spark, folder, "documents")
    for _, f in corpus_pipeline.STAGES[:n]:
        docs = stash(f(spark, docs, folder))
    return docs, stash(corpus_pipeline.STAGES[n][1](spark, docs, folder))


def test_language_drops_texts_without_letters_only(spark, folder):
    before, after = run(spark, folder, 0)
    assert after.columns == list(corpus_pipeline.COLUMNS)
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert gone == {400, 401, 402} and after.count() == before.count() - 3


def test_lines_drop_boilerplate_and_keep_documents(spark, folder):
    before, after = run(spark, folder, 1)
    assert before.count() == after.count()
    was, now = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    hosts: dict = {}
    for r in was.values():
        hosts.setdefault(r.source, []).append(set(r.text.split("\n")))
    for i, r in now.items():
        pages = hosts[was[i].source]
        bad = lambda x, pages=pages: (n := sum(x in p for p in pages)) >= linededup.MIN_PAGES and n > linededup.RATIO * (len(pages) + (was[i].source == was[3].source))  # noqa: E731, B023
        assert r.text == "\n".join(x for x in was[i].text.split("\n") if not bad(x)) and r.n_chars == len(r.text)


def test_one_of_each_group_stays(spark, folder):
    before, after = run(spark, folder, 2)
    kept = [(r.doc_id, sets(r.text)) for r in after.collect()]
    assert len({d for d, _ in kept}) == len(kept)
    for i, (_, a) in enumerate(kept):
        assert all(len(a & b) / len(a | b) < 0.8 for _, b in kept[:i])
    for r in before.collect():
        s = sets(r.text)
        assert any(len(s & b) / len(s | b) >= 0.8 for _, b in kept)


def test_mixture_repeats_by_weight(spark, folder):
    before, after = run(spark, folder, 3)
    words = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    old, new = before.collect(), after.collect()
    had, has = words(old), words(new)
    assert {(r.doc_id, r.text) for r in new} <= {(r.doc_id, r.text) for r in old}
    from millrace.llm.mixing import targets

    order = sorted(had, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, targets([had[s] for s in order], [1.0 + i % 3 for i in range(len(order))]), strict=True):
        longest = max(len(r.text.split()) for r in old if r.source == s)
        assert abs(has.get(s, 0) - t) <= longest + 5


def test_run_packs_everything(spark, folder):
    docs, pieces = run(spark, folder, 4)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(p.length for p in got) == sum(p.length for p in pieces.collect())
    assert {p.doc_id for p in got} == {r.doc_id for r in docs.collect()}
    assert jaccard.SIMILARITY == 0.8 and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_third_of_copies_leaves_one_with_its_text(spark):
    r = random.Random(6)
    text = lambda: "\n".join(" ".join(f"w{r.randrange(500)}" for _ in range(20)) for _ in range(6))
    copy, near = text(), text().split("\n")
    rows = [(i, text(), "s") for i in range(60)] + [(100 + i, copy, "s") for i in range(30)]
    rows += [(200 + i, "\n".join([*near, f"w{i}"]), "t") for i in range(20)] + [(300 + i, text(), "t") for i in range(40)]
    rows += [(400 + i, "\n".join(near[k] for k in range(6) if k != i % 6), "u") for i in range(12)]
    docs = spark.createDataFrame([(a, b, "en", c, len(b)) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.mixture):
        docs = linededup.stash(stage(spark, docs, ""))
        got = {x.doc_id: x.text for x in docs.collect()}
        assert got[100] == copy and any(near[0] in t for t in got.values())
    assert sum(t == copy for t in got.values()) == 1


def test_rows_that_share_an_id_are_told_apart(spark):
    """(0, B z), (1, A), (1, B): B goes as a near copy of B z, A stays; and each stage bears nulls in every column."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    schema = "doc_id long, text string, lang string, source string, n_chars long, name string, taken int"
    rows = [(0, b + " z"), (1, a), (1, b), (1, a), (None, "c d e f g h"), (None, None), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, "n", 3) for i, t in rows], schema)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got) == [(-1, ""), (-1, "c d e f g h"), (0, b + " z"), (1, a), (5, ""), (5, "")]
    mixed = [corpus_pipeline.mixture(spark, docs.repartition(n), "").collect() for n in (1, 3)]
    assert sorted(map(repr, mixed[0])) == sorted(map(repr, mixed[1]))
    for stage in (corpus_pipeline.language, corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.mixture):
        assert stage(spark, docs, "").columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.lines(spark, docs, "").count() == len(rows)


def test_mixture_shares_what_is_taken_among_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(7, text, "en", s, 9) for s in ("a", "a", "b")] + [(7, text + " x", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixture(spark, docs, "").collect()
    assert {(r.text, r.source) for r in got} <= {(text, "a"), (text, "b"), (text + " x", "a")}
    words = {s: sum(len(r.text.split()) for r in got if r.source == s) for s in "ab"}
    assert abs(words["a"] - 67) <= 51 and abs(words["b"] - 134) <= 51  # to whole copies
