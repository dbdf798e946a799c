"""The registered queries over the smallest tables: whole results, SQL twins, and contracts."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from millrace.llm import packing, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def result(spark, start):
    name = next(n for n in queries.queries() if n.startswith(start))
    return queries.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    c = duckdb.connect()
    for x in os.listdir(SF):
        c.execute(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{SF}/{x}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda f: sorted(map(str, f[columns].itertuples(index=False)))
    assert key(got) == key(want)


@pytest.mark.parametrize("start", ["op1_", "op3_", "op4_", "op5_", "op6_", "op8_", "op10_"])
def test_one_row_a_document(spark, docs, start):
    assert sorted(result(spark, start).doc_id) == sorted(docs.doc_id)


def test_nearest_recall(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"].to_list()).astype(float), e.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, hits = result(spark, "op2_").groupby("query_id").vec_id.apply(set), []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hits.append(len(set(ids[np.argsort(-s)[:5]]) & got[ids[i]]) / 5)
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_image_copies(spark):
    r = result(spark, "op7_").set_index("media_id").group_id
    copied = [i for i in r.index if i % 20 == 7]
    assert np.mean([r[i] == r[i - 1] for i in copied]) >= 0.9
    assert all(r[i] == i for i in r.index if i % 20 != 7)


def test_pieces_are_the_documents_ids(spark, docs):
    pieces, ids = result(spark, "op9_"), packing.Ids(packing.default_tokenizer())
    full = {d: x + b"\0\0\0\0" for d, x in zip(docs.doc_id, ids.encode(docs.text.fillna("").to_list()), strict=True)}
    for p in pieces.itertuples():
        assert zlib.crc32(full[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
    assert pieces.length.sum() * 4 == sum(map(len, full.values()))


def test_held_out_accuracy(spark, docs):
    lang = result(spark, "op5_").merge(docs, on="doc_id")
    lang = lang[lang.held_out]
    assert (lang.lang_pred == lang.lang).mean() > 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    quality = result(spark, "op10_").merge(labels, on="doc_id")
    quality = quality[quality.held_out]
    assert (quality.predicted == quality.quality).mean() > 0.8


def test_the_model_beats_its_base(spark):
    r = result(spark, "op4_")
    r = r[r.held_out]
    assert r.score.sum() > r.base_score.sum()
