"""Sources: positions, blocks and CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def from_slice(spark: SparkSession, values: list, kind: str) -> DataFrame:
    """pos, v of a list, 0-based."""
    return spark.createDataFrame(list(enumerate(values)), f"pos long, v {kind}")


def from_array(df: DataFrame, array: str) -> DataFrame:
    return df.select("*", F.posexplode(array).alias("pos", "v"))


def from_map(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("k", "v"))


def indexed(df: DataFrame, *order: str | Column, chunks: int = 1024) -> DataFrame:
    """pos: dense and 0-based in that order, rows that tie by a hash of their columns. Ranges are
    counted first, so no task sorts all rows. The ranges are written, as two reads of one plan may cut them
    differently."""
    rest = [F.xxhash64(*(f"`{c}`" for c, kind in df.dtypes if "map<" not in kind)).alias("__tie")]
    spread = durable(df.select("*", *rest).repartitionByRange(chunks, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    counts = spread.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    base = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__tie")) - 1
    numbered = spread.withColumn("__within", within).join(base, "__part")
    return numbered.withColumn("pos", F.col("__base") + F.col("__within")).drop("__part", "__within", "__base", "__tie")


def durable(df: DataFrame) -> DataFrame:
    """df written to the folder that all machines share, and read back: every later read sees the same rows in
    the same partitions, and no lost executor undoes them."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(folder)
    path = f"{folder}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process; local-cluster is not."""
    return master.startswith("local") and not master.startswith("local-cluster")


def take_channel(log: DataFrame, cancel_after: int | None = None) -> DataFrame:
    """A channel is a log by pos; cancelling after n receives leaves exactly the first n."""
    return log if cancel_after is None else log.filter(F.col("pos") < cancel_after)


def blocks(df: DataFrame, items: int, pos: str = "pos") -> DataFrame:
    """block_id: runs of that many positions, the last one shorter."""
    if items < 100:
        raise ValueError("a block holds at least 100 items")
    return df.withColumn("block_id", F.floor(F.col(pos) / items))


#: The columns of a violations file that are kept, by their names in the file and in the table.
VIOLATIONS = {
    "businessname": "business_name",
    "licstatus": "license_status",
    "result": "result",
    "violdesc": "description",
    "violdttm": "time",
    "violstatus": "status",
    "viollevel": "level",
    "comments": "comments",
    "address": "address",
    "city": "city",
    "zip": "zip",
}


def violations_csv(spark: SparkSession, path: str) -> DataFrame:
    """The kept columns of a CSV file with a header, as strings, whatever else it has."""
    head = spark.read.option("header", True).csv(path).limit(0).columns
    schema = StructType([StructField(c, StringType()) for c in head])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in VIOLATIONS))
