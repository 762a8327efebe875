"""The call ledger as a stream: daily roll-up, deduplication and upsert, each a bounded run that ends when the input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill import shared
from citemill.streaming.state import cache_lookups, keyed_state, waves


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    return shared.scratch(spark, "streams")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; a watermark needs a time with a zone, so timestamps without one count as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(rows: DataFrame, mode: str) -> DataFrame:
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    q = rows.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by day and endpoint, each day once, when the watermark has passed its end."""
    e = events(spark, sf_dir).withWatermark("ts", "1 day")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("endpoint")).agg(F.count("*").alias("calls"))
    return _run(g, "append").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "endpoint", "calls")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sight of each user and kind of event; state is dropped a year behind the watermark."""
    e = events(spark, sf_dir).withWatermark("ts", "365 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return _run(e.select("user_id", "event_type"), "append")


def stream_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of calls by user: calls at most six hours apart, each wave once, when the watermark has passed its end."""
    e = events(spark, sf_dir).withColumnRenamed("value", "cost")
    return _run(waves(e, "user_id", "6 hours", "1 day"), "append")


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a lookup of its user's entry, which is good for 21 days."""
    e = events(spark, sf_dir).withColumnRenamed("event_id", "id")
    with keyed_state(spark):
        return _run(cache_lookups(e, "user_id"), "append")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by user that every batch merges into: a new version for each batch, read from the last one."""
    folder = scratch(spark)
    schema = "user_id long, n long, last_event long"
    version: list[str] = []

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
        old = spark.read.schema(schema).parquet(version[-1]) if version else None
        both = new if old is None else old.unionByName(new).groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
        path = f"{folder}/table/v{number}-{uuid.uuid4().hex}"
        both.write.parquet(path)
        version.append(path)

    q = events(spark, sf_dir).writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(version[-1])


def daily_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scheduler runs: all input there is, in complete mode through a batch function, then the end."""
    folder = scratch(spark)
    schema = "day string, endpoint string, calls long"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/batches/{number}")
        done.append(f"{folder}/batches/{number}")

    done: list[str] = []
    e = events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("endpoint"))
    q = e.writeStream.foreachBatch(lambda b, i: write(b.groupBy("day", "endpoint").agg(F.count("*").alias("calls")), i)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(*done).groupBy("day", "endpoint").agg(F.sum("calls").alias("calls"))
