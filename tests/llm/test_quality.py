import math
import random

import numpy as np
import zstandard as zstd
from millrace.llm import quality
from pyspark.sql import functions as F


def text(r, good):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ar", "en", "ist", "o")]
    out = " ".join(r.choice(words) for _ in range(r.randint(20, 200)))
    return out if good else out.upper().replace(" ", " $$$ ")


def frames(spark, n=300, classes=(0, 1)):
    r = random.Random(0)
    rows = [(i, text(r, i % 3 > 0), int(i % 3 > 0)) for i in range(n) if int(i % 3 > 0) in classes]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return df.select("doc_id", "text", F.lit(False).alias("held_out")), df.select("doc_id", "label")


def test_learns_and_scores_held_out_texts(spark):
    docs, labels = frames(spark)
    extra = spark.createDataFrame([(0, None), (None, 1), (5, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels.filter("doc_id < 200").union(extra))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].predicted == int(i % 3 > 0) for i in range(200, 300)) >= 98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_scores_equal_a_plain_model(spark):
    """Dictionaries, differences and calibration by their definitions, in one process."""
    docs, labels = frames(spark)
    t = {r.doc_id: r.text.encode() for r in docs.collect()}
    pieces = lambda b: [b[i : i + quality.CHUNK] for i in range(0, len(b), quality.CHUNK)]
    half: dict = {}
    for k in (0, 1):
        ids = sorted(i for i in t if int(i % 3 > 0) == k)
        half[k] = ids[::2], ids[1::2]
    tools = []
    for k in (0, 1):
        d = zstd.ZstdCompressionDict(quality.dictionary([c for i in half[k][0] for c in pieces(t[i])]))
        tools.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False))
    x = {}
    for i, b in t.items():
        bad, good = (sum(len(tool.compress(c)) for c in pieces(b)) for tool in tools)
        share = math.log((good + bad) / (2 * len(b)))
        x[i] = np.array([1, (bad - good) / (bad + good), share, share**2, math.log(len(b))])
    rest = sorted((i, k) for k in (0, 1) for i in half[k][1])
    w = quality.calibrate(np.array([x[i] for i, _ in rest]), np.array([k for _, k in rest], float))
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        assert abs(r.score - 1 / (1 + math.exp(-min(30, max(-30, w @ x[r.doc_id]))))) < 1e-9


def test_calibration_is_the_best_logistic_fit():
    r = np.random.default_rng(0)
    x = np.column_stack([np.ones(400), r.normal(0.02, 0.05, 400), r.normal(3, 1, 400)])
    y = (r.random(400) < 1 / (1 + np.exp(-(40 * x[:, 1] - x[:, 2] + 2)))).astype(float)
    w = quality.calibrate(x, y, ridge=0)
    loss = lambda v: np.log1p(np.exp(x @ v)).sum() - y @ (x @ v)
    assert all(loss(w) <= loss(w + d) for d in (*(1e-3 * np.eye(3)), *(-1e-3 * np.eye(3))))


def test_sample_is_bounded_and_texts_are_whole(spark):
    docs, labels = frames(spark)
    long = spark.createDataFrame([(0, "A $$$ " * 60_000, False)] + [(7, f"b{i:04} ar", False) for i in range(500)], "doc_id long, text string, held_out boolean")
    model = quality.fit(docs.union(long), labels, sample=20)
    assert model.weights is not None and abs(model.rate - 0.5) < 0.1
    whole = "A $$$ " * 60_000 + "bar den fist go " * 60_000
    assert model.features(whole.encode()) != model.features(whole.encode()[:300_000])


def test_cases(spark):
    docs, labels = frames(spark)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, False, 9), (2, "", True, 9), (None, "a", False, 9), (1, None, False, 9)], "doc_id long, text string, held_out boolean, label int")
    got = quality.score(odd, model).collect()
    assert len(got) == 4 and all(abs(r.score - model.rate) < 1e-12 for r in got if r.doc_id in (1, 2))
    assert quality.score(odd.limit(0), model).count() == 0
    docs, labels = frames(spark, classes=(1,))
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_same_texts_same_scores_after_shipping(spark):
    docs, labels = frames(spark, 120)
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(20).collect():
        assert abs(r.score - model.score(r.text.encode())) < 1e-12
