"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them in Parquet, and returns what
stays; all but the last return the columns of documents, and other columns of docs don't go on. Any column
may be null; an empty table gives an empty one. What each stage makes of nulls, ties and repeated rows is in
its docstring; where rows are told apart, it is by all their columns, as ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, linededup, mixing, packing
from millrace.llm.common import held_out, read, stash
from millrace.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this the best language is not surer than all others together.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, null and empty texts among them, or in no language that stands out go. Where
    two languages tie, neither stands out. Repeated rows stay or go alike; null languages teach nothing, and
    where nothing can be learned all go."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(~held_out("doc_id", 4, 2)).select("lang", "text"))
    said = langid.predict(docs, model, *COLUMNS)
    return said.filter((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= SURE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the texts; every document stays, and keeps its text
    if all of it would go. Copies of a text count once, so that a group of them is left to near_duplicates.
    Repeated rows are cleaned alike; null texts stay null, and a null source is one source."""
    ship(spark)
    clean = linededup.drop_boilerplate(docs.select(*COLUMNS), "source", distinct=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays, null ids first, among equal ids the
    one with the smallest digest of its text, and of rows equal in both, one. Texts without words are linked to
    none: each stays, once an id."""
    ship(spark)
    named = docs.select(*COLUMNS).withColumn("name", F.struct("doc_id", F.unhex(F.md5("text")).alias("digest")))
    found = jaccard.join(named.select(F.col("name").alias("doc_id"), "text"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("group_id"))).select(F.col("doc_id").alias("name")).distinct()
    rest = F.struct(*(F.col(c) for c in COLUMNS if c not in ("doc_id", "text")))  # rows that differ in these only: the least stays
    one = named.groupBy("name").agg(F.min(F.struct(rest.alias("rest"), "text")).alias("one")).join(kept, "name", "left_semi")
    return one.select(F.col("name.doc_id").alias("doc_id"), F.col("one.text").alias("text"), *(f"one.rest.{c}" for c in COLUMNS if c not in ("doc_id", "text"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, to the nearest whole copy; rows equal in all columns
    share what the mix takes of them. Null texts and texts without words are not taken; a null source is one
    source. Reruns agree: rows of one id and size stand in the mix by a digest of all columns."""
    ship(spark)
    named = docs.select(*COLUMNS).withColumn("name", F.md5(F.to_json(F.struct(*COLUMNS)).cast("binary")))
    taken = mixing.taken(named.select("doc_id", "source", "text", "name"), carry=("name",)).filter("size > 0")
    times = taken.groupBy(F.col("name").alias("of")).agg(F.round(F.sum("taken") / F.max("size")).cast("int").alias("copies")).filter("copies > 0")
    rows = named.join(times, F.col("name") == F.col("of")).dropDuplicates(["name"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens. Null and empty texts are a closing id;
    repeated rows are documents of their own."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", pack),
]

#: Language ID, MinHash candidates and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
