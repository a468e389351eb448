"""Streams: an index kept up with a folder of chunks, and activity of users in windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.operators.corpus import exists, latest, remove


def follow(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: tuple[str, ...] = ("id",), parts: int = 16):
    """Keep `target` (parquet, in `parts` buckets of a chunk's key) up with the chunk files that arrive in `source`: of
    each key the row indexed last. Only buckets that a batch touches are read and written again."""
    stream = spark.readStream.schema(schema).parquet(source)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = batch.withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `parts`
        fresh_and_old = fresh
        if exists(spark, target):  # else there is no index yet; an index that can't be read fails the batch
            fresh_and_old = fresh.unionByName(spark.read.parquet(target).filter(F.col("bucket").isin(touched)).select(fresh.columns))
        merged = latest(fresh_and_old.withColumn("_key", F.struct(*keys)), "_key").drop("_key")
        staged = f"{target}_staged_{epoch}"
        merged.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        remove(spark, staged)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and their values by window and type; on a stream, rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("started"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events no further apart than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")
