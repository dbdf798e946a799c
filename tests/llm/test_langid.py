import math

import numpy as np
import pytest
from millrace.llm import langid

EN = "the cat and the dog were running over the green hills while it was raining".split()
DE = "der hund und die katze sind über grüne hügel gelaufen während es geregnet hat".split()


@pytest.fixture(scope="module")
def pieces():
    return langid.pieces_by(langid.default_vocabulary())


def plain(word, pieces, p):
    """The sum over all ways to cut the word, by recursion."""
    known = set(pieces.pieces)
    at = {x: i for i, x in enumerate(pieces.pieces)}
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(pieces.longest, len(word)) + 1):
        x = word[:n]
        if x in known:
            total += p[at[x]] * plain(word[n:], pieces, p)
        elif n == 1:
            total += langid.UNKNOWN * plain(word[n:], pieces, p)
    return total


def table(pieces, seed=0):
    p = np.random.default_rng(seed).dirichlet(np.ones(pieces.count))
    return np.concatenate([p, [0, langid.UNKNOWN]])[:, None]


@pytest.mark.parametrize("word", ["▁the", "▁hügel", "▁a", "▁日本語", "ing", "▁xqzzy"])
def test_forward_sums_all_cuts(pieces, word):
    t = table(pieces)
    with np.errstate(over="ignore"):
        got = langid.forward(pieces.cuts([word, word]), t)[-1]
    assert np.allclose(got[:, 0], plain(word, pieces, t[:, 0]), rtol=1e-9)


def test_expected_counts_cover_each_letter(pieces):
    words = ["▁the", "▁cat", "▁hügel", "ing"]
    with np.errstate(over="ignore"):
        e = langid.expected(pieces, words, np.array([1.0, 2, 3, 4]), table(pieces))
    letters = sum(n * len(p) for n, p in zip(e, pieces.pieces, strict=False)) + e[pieces.count + 1]
    assert math.isclose(letters, 4 * 1 + 4 * 2 + 6 * 3 + 3 * 4, rel_tol=1e-9)


def rows():
    out = []
    for i in range(60):
        words = (EN, DE)[i % 2]
        out.append((i, ("en", "de")[i % 2], " ".join(words[(i + j) % len(words)] for j in range(8))))
    return out


def test_predictions_and_cases(spark):
    train = spark.createDataFrame([*rows(), (99, None, "unbekannt"), (98, "en", None)], "doc_id long, lang string, text string")
    model = langid.fit(train.select("lang", "text"))
    assert model.langs == ["de", "en"]
    tests = [(1, "THE GREEN HILLS"), (2, "grüne hügel"), (3, None), (4, "123 !!"), (5, ""), (6, "the" * 5000), (1, "THE GREEN HILLS"), (None, "der hund")]
    df = spark.createDataFrame([(*t, 0) for t in tests], "doc_id long, text string, score int")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(df, model, "doc_id").collect())
    assert got == [(0, "de"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    assert all(0 <= r.score <= 1 for r in langid.predict(df, model, "doc_id").collect())
    assert langid.predict(df.limit(0), model, "doc_id").count() == 0


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "lang string, text string")
    model = langid.fit(none)
    df = spark.createDataFrame([(1, "words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, model, "doc_id").collect()] == [("und", 0.0)]


def chart(word, at, p, longest):
    """Forward and backward sums of all cuts, by the definition."""
    n = len(word)
    piece = lambda i, j: p[at[word[i:j]]] if word[i:j] in at else langid.UNKNOWN if j == i + 1 else 0.0
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        a[j] = sum(a[i] * piece(i, j) for i in range(max(0, j - longest), j))
    for i in range(n - 1, -1, -1):
        b[i] = sum(piece(i, j) * b[j] for j in range(i + 1, min(n, i + longest) + 1))
    return a, b, piece


def test_words_of_any_length_are_summed_whole(pieces):
    t, at = table(pieces), {x: i for i, x in enumerate(pieces.pieces)}
    words = ["▁" + "donaudampfschifffahrtsgesellschaft", "▁" + "日本語" * 9 + "investigation", "▁" + "constitutioninvestigation" * 2]
    for w in words:
        a, _, _ = chart(w, at, t[:, 0], pieces.longest)
        with np.errstate(over="ignore"):
            assert np.allclose(langid.long_forward(pieces, pieces.codes([w]), t)[-1], np.log(a[-1]), rtol=1e-9)
    with np.errstate(over="ignore"):
        far = langid.long_forward(pieces, pieces.codes(["▁" + "ꔀ" * 3000]), t)[-1][0, 0]
    assert math.isclose(far, 3000 * math.log(langid.UNKNOWN) + math.log(t[at["▁"], 0]), rel_tol=1e-9)
    assert any(len(x) > 12 for x in pieces.pieces) and pieces.longest == max(map(len, pieces.pieces))


def test_long_words_are_counted_like_short_ones(pieces):
    t, words = table(pieces), ["▁constitutioninvestigationofthe", "▁investigationundgesellschaften"]
    one, two = np.zeros(pieces.count + 2), np.zeros(pieces.count + 2)
    at = {x: i for i, x in enumerate(pieces.pieces)}
    with np.errstate(over="ignore"):
        for w, n in zip(words, (2.0, 3.0), strict=True):
            langid.long_expected(pieces, pieces.codes([w]), np.array([n]), t, one)
            a, b, piece = chart(w, at, t[:, 0], pieces.longest)
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + pieces.longest) + 1):
                    two[at.get(w[i:j], pieces.count + 1)] += n * a[i] * piece(i, j) * b[j] / a[-1]
    assert np.allclose(one, two, rtol=1e-9, atol=1e-12)


def test_predictions_equal_a_plain_model(spark, pieces):
    """Learning and prediction by the definitions, one word and one cut at a time."""
    docs = [*rows(), (90, "de", "donaudampfschifffahrtsgesellschaftskapitän der"), (91, "en", "The 42 CATS, the")]
    at, langs, longest = {x: i for i, x in enumerate(pieces.pieces)}, ["de", "en"], pieces.longest
    count = {k: {} for k in langs}
    for _, lang, text in docs:
        for w in langid.WORD.findall(text.lower()):
            count[lang]["▁" + w] = count[lang].get("▁" + w, 0) + 1
    p = {k: np.full(len(at), 1.0 / len(at)) for k in langs}
    for _ in range(langid.ROUNDS):
        for k in langs:
            e = np.full(len(at), langid.ALPHA)
            for w, n in count[k].items():
                a, b, piece = chart(w, at, p[k], longest)
                for i in range(len(w)):
                    for j in range(i + 1, min(len(w), i + longest) + 1):
                        if w[i:j] in at:
                            e[at[w[i:j]]] += n * a[i] * piece(i, j) * b[j] / a[-1]
            p[k] = e / e.sum()
    ask = ["the hügel", "während dogs donaudampfschifffahrtsgesellschaft", "日本", "12", None, "der the", "Green HILLS were"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    model = langid.fit(spark.createDataFrame([(k, t) for _, k, t in docs], "lang string, text string"))
    got = {r["doc_id"]: r for r in langid.predict(df, model, "doc_id").collect()}
    share = {k: sum(x[1] == k for x in docs) / len(docs) for k in langs}
    for i, t in enumerate(ask):
        words = ["▁" + w for w in langid.WORD.findall((t or "").lower())]
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = [math.log(share[k]) + sum(math.log(chart(w, at, p[k], longest)[0][-1]) for w in words) for k in langs]
        best = int(np.argmax(logs))
        assert got[i]["lang_pred"] == langs[best]
        assert math.isclose(got[i]["score"], 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-6)


def test_what_a_task_remembers_is_bounded_in_bytes(pieces):
    known = langid.Known(2, most=50_000)
    for i in range(40):
        words = {f"w{i}x{j}" * 5 for j in range(20)}
        known.learn(words, lambda new: np.array([[len(w), 1.0] for w in new]))
        assert known.row.size <= 50_000
        assert all(known.scores[known.row.of[w], 0] == len(w) for w in words)
