"""Streams of append-only records: event-time windows with late data, and the latest record of each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of Parquet as a stream; the schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def windowed_stream(spark: SparkSession, path: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_stream(spark: SparkSession, path: str) -> DataFrame:
    return stream(spark, path).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def settle(streamed: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and give its result as a table. Each batch replaces the table in the shared folder,
    where the query's own checkpoint is too, so results of any size stay off the driver and a restart goes on where it was."""
    spark = streamed.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result")

    query = streamed.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{place}/result")
