"""Quality by compression: a text that a dictionary of good texts compresses better is good.

Two zstandard dictionaries are built from texts with label 1 and label 0. A text is cut into chunks of
CHUNK bytes, so that the dictionary and not the text's own past decides, and each is compressed with both.
The normalised difference (bad - good) / (bad + good) of the summed sizes, with the compressed share and the
length of the text (words said over and over are in neither dictionary), goes through a logistic calibration fitted on labelled texts that built no dictionary.

Learning takes a bounded sample: at most SAMPLE labelled ids a class, the first by a hash of the id, with their
whole texts, half for the dictionaries and half for the calibration. Each dictionary is built in one task from
its class's texts; what the calibration needs is computed where the texts are, so that two dictionaries and
a few numbers a sampled row are all that comes to the driver. The sample's ids and the dictionaries are all
that is broadcast; scoring is one pass without a shuffle.

Cases: a null or empty text, and every text where labels of one class only were learned, scores the rate of
label 1 in the sample, 0.5 without labels; null labels and null ids teach nothing; an id with both
labels teaches both, and one that several texts have teaches by the least of them; repeated rows are scored alike; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import batches, discard, held_out, only, read, stash, texts

SAMPLE, CHUNK, DICTIONARY, CUT, RIDGE = 4000, 2048, 112_640, 0.3, 0.1
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


def dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few samples to train on: their own bytes serve
        return b"".join(samples)[-DICTIONARY:]


class Model:
    """Scores texts; holds bytes and floats only, so that it can be sent to workers."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None, rate: float):
        self.good, self.bad, self.weights, self.rate = good, bad, weights, rate

    def features(self, text: bytes) -> list[float]:
        if not hasattr(self, "tools"):
            self.tools = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d), write_content_size=False) for d in (self.good, self.bad)]
        good, bad = (sum(len(tool.compress(x)) for x in chunks(text)) for tool in self.tools)
        share = np.log((good + bad) / (2 * len(text)))
        return [1.0, (bad - good) / (bad + good), share, share * share, np.log(len(text))]

    def score(self, text: bytes) -> float:
        if not text or self.weights is None:
            return self.rate
        return float(1 / (1 + np.exp(-np.clip(self.weights @ self.features(text), -30, 30))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tools"}


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method, features on one scale; the first feature is 1 and bears no penalty."""
    size = np.append(1.0, x[:, 1:].std(axis=0) + 1e-12)
    mean = np.append(0.0, x[:, 1:].mean(axis=0))
    z, w, penalty = (x - mean) / size, np.zeros(x.shape[1]), np.append(1e-6, np.full(x.shape[1] - 1, ridge))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    w = w / size
    return np.append(w[0] - mean[1:] @ w[1:], w[1:])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id, label; rows of both that may teach."""
    marked = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    order = F.xxhash64("doc_id")
    first = [marked.filter(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(first[0].unionByName(first[1]).withColumnRenamed("doc_id", "of"))
    rows = docs.join(picked, F.col("doc_id") == F.col("of")).filter("text != ''").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("doc_id")) % 2  # a bounded sample
    rows = stash(rows.withColumn("builds", turn == 1))
    seen = {(r["label"], r["builds"]): r["n"] for r in rows.groupBy("label", "builds").agg(F.count("*").alias("n")).collect()}
    whole = sum(seen.values())
    rate = sum(n for (k, _), n in seen.items() if k == 1) / whole if whole else 0.5
    if len(seen) < 4:
        discard(rows)
        return Model(b"", b"", None, rate)

    def build(f: pd.DataFrame) -> pd.DataFrame:
        texts_ = f.sort_values("doc_id")["text"]
        return pd.DataFrame({"label": [f["label"].iloc[0]], "built": [dictionary([c for t in texts_ for c in chunks(t.encode())])]})

    built = {r["label"]: bytes(r["built"]) for r in rows.filter("builds").groupBy("label").applyInPandas(build, "label int, built binary").collect()}
    model = Model(built[1], built[0], None, rate)

    def measure(source):
        for batch in batches(source):
            found = [model.features(t) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    measured = rows.filter("NOT builds").select("doc_id", "label", "text").mapInArrow(measure, "doc_id long, label int, x array<double>").collect()
    measured.sort(key=lambda r: (r["doc_id"], r["label"]))
    model.weights = calibrate(np.array([r["x"] for r in measured]), np.array([r["label"] for r in measured], dtype=float))
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs: doc_id, held_out, text."""

    def run(source):
        for batch in batches(source):
            s = np.array([model.score(t) for t in texts(batch.column(2))], dtype=float)
            columns = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    docs = only(read(spark, sf_dir, "documents"), doc_id="doc_id", text="text").withColumn("held_out", held_out("doc_id", 5, 0))
    labels = only(read(spark, sf_dir, "labels"), doc_id="doc_id", label="quality").filter(~held_out("doc_id", 5, 0))
    return score(docs, fit(docs, labels))
