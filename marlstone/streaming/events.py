"""Structured Streaming over event tables, an extension: lateness, upserts and bins as the batch operators have them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import shared_dir


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files at ``path``: a folder, or a single file, which streams only as part of its folder."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.rstrip("/").endswith("/" + name) for f in spark.read.parquet(path).inputFiles()):
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def windowed(events: DataFrame, at: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window; rows later than the watermark are dropped, as a batch lateness filter would."""
    e = events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    e = events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """The latest value per key, superseding as rows arrive: a keyed upsert in update mode."""

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        best = old
        for pdf in batches:
            for t, i, v in zip(pdf["_us"], pdf[tie], pdf[value], strict=True):
                if best is None or (int(t), int(i)) > (best[0], best[1]):
                    best = (int(t), int(i), float(v))
        if best != old:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], "us": [best[0]], tie: [best[1]], value: [best[2]]})

    kind = events.schema[key].dataType.simpleString()
    e = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).where(F.col(value).isNotNull())
    return e.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, us bigint, {tie} bigint, {value} double", "us bigint, id bigint, v double", "update", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs what is there to the end into a table of the shared folder and returns it; no row passes the driver.

    In complete mode each batch replaces the table, else its rows are added.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
