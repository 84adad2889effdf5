"""Structured Streaming: polling, deduplication, windows, run grouping and batch writers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillflow.records import plain


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """New files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def polled(spark: SparkSession, source: Callable[[SparkSession], DataFrame], operator: Callable[[DataFrame], DataFrame], interval: float = 15, times: int = 0) -> int:
    """Read a source again and again and apply an operator that writes; 0 times: for ever. The number of rounds."""
    rounds = 0
    while not times or rounds < times:
        operator(source(spark))
        rounds += 1
        if not times or rounds < times:
            time.sleep(interval)
    return rounds


def deduplicated(df: DataFrame, key: str, time_column: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first record of each key: within the watermark, so that the state is bounded, if there is a time."""
    return df.withWatermark(time_column, within).dropDuplicatesWithinWatermark([key]) if time_column else df.dropDuplicates([key])


def windowed_counts(df: DataFrame, time_column: str, key: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows."""
    w = F.window(plain(time_column), width, slide) if slide else F.window(plain(time_column), width)
    return df.withWatermark(time_column, late).groupBy(w, plain(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), plain(key), "n")


def session_counts(df: DataFrame, time_column: str, key: str, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(plain(time_column), gap)
    return df.withWatermark(time_column, late).groupBy(w, plain(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), plain(key), "n")


def run_groups(df: DataFrame, partition: str, key: str, order: str) -> DataFrame:
    """Runs of equal keys within each partition, a row when the next key arrives: (partition, key, n, first, last)."""

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, 0, 0, 0]
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for k, o in zip(rows[key].astype(str), rows[order], strict=True):
            if held[1] and k == held[0]:
                held[1], held[3] = held[1] + 1, int(o)
            else:
                if held[1]:
                    out.append((str(group[0]), *held))
                held = [k, 1, int(o), int(o)]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["partition", "key", "n", "first", "last"])

    return df.groupBy(partition).applyInPandasWithState(step, "partition string, key string, n long, first long, last long", "key string, n long, first long, last long", "append", GroupStateTimeout.NoTimeout)


def write_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, interval: str = "15 seconds"):
    """Give each micro-batch to a writer; offsets are kept in the checkpoint."""
    stream = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=interval)).start()


def collected(df: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote; mode complete keeps the last result."""
    spark = df.sparkSession
    if mode == "append":
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
    else:
        df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
