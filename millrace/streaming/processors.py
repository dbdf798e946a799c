"""Streaming twins: per-key state over micro-batches.

Micro-batches don't keep the order of rows, so every stream carries a position and each batch is put in order
before it meets the state; a position not above the state's last is late and is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def sequence(stream: DataFrame, key: str, pos: str) -> DataFrame:
    """key, pos, seq: dense 0-based numbers of each key's rows in order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(pos)
        rows = rows if last is None else rows[rows[pos] > last]
        yield pd.DataFrame({key: [k[0]] * len(rows), pos: rows[pos].to_numpy(), "seq": range(n, n + len(rows))})
        state.update((n + len(rows), int(rows[pos].iloc[-1]) if len(rows) else last))

    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {pos} {kinds[pos]}, seq long"
    return stream.select(key, pos).groupBy(key).applyInPandasWithState(step, out, "n long, last long", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, ts: str, pos: str, idle_seconds: float) -> DataFrame:
    """key, pos, session, seq: a key's state starts anew where it was idle for longer, by event time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, n, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(frames)).sort_values([ts, pos])
        out = []
        for at, p in zip(rows[ts].astype("datetime64[us]").astype("int64") / 1e6, rows[pos], strict=True):
            if last is not None and at < last:
                continue  # late
            if last is not None and at - last > idle_seconds:
                session, n = session + 1, 0
            out.append((k[0], p, session, n))
            n, last = n + 1, at
        state.update((session, n, last))
        yield pd.DataFrame(out, columns=[key, pos, "session", "seq"])

    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {pos} {kinds[pos]}, session long, seq long"
    return stream.select(key, ts, pos).groupBy(key).applyInPandasWithState(step, out, "session long, n long, last double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """key, begin, n by event-time windows; rows later than the watermark are left out."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").cast("timestamp_ntz").alias("begin"), "n")


def feed(stream: DataFrame, folder: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> str:
    """Runs the stream to its end, folding each micro-batch into a table kept as numbered versions under folder;
    returns the last one's path. A batch that runs again writes its own version again."""
    spark = stream.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def latest(below: int | None = None) -> str:
        """The last version that is whole, by the folder alone: a run that starts from a checkpoint finds it."""
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        found = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}/_SUCCESS"))]
        number = max((n for n in whole if below is None or n < below), default=None)
        return "" if number is None else f"{folder}/v{number}"

    def step(batch: DataFrame, number: int) -> None:
        before = latest(number)
        fold(spark.read.parquet(before) if before else None, batch).write.mode("overwrite").parquet(f"{folder}/v{number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest()


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end into Parquet and reads that back."""
    out = f"{folder}/out-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
