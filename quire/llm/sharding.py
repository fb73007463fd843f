"""Longest-processing-time scheduling of groups that must stay together.

Groups (equal texts) are weighed by one aggregation. LPT then takes items by falling size and
gives each to the least-loaded shard of a heap. Two kinds of items keep the driver's share
bounded whatever the corpus holds:

* heavy groups, of at least ``1 / (shards * fine)`` of all bytes: at most ``shards * fine`` exist;
* bundles: all lighter groups fall into ``shards * bundles`` bundles by a hash of their key.

Loads differ by at most the last item given, a bundle of ``1 / bundles`` of a shard or so, unless
one group alone outweighs a shard: groups are never split. The other exception is a corpus of few
groups, where LPT's own bound (4/3 of the optimum) holds.

Edge cases: a null text counts as no bytes and groups with the empty text; null ids are rows like
others; repeated rows each get a slot; an empty table gives an empty result; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, empty_for_null, table

OVERHEAD = 16


def lpt(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """(size, key) by falling size to the least-loaded shard; ties by key, then by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def weighed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, checksum of the text and the key of its group."""
    text = empty_for_null(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )


def schedule(rows: DataFrame, shards: int = 40, fine: int = 1000, bundles: int = 256) -> DataFrame:
    """``rows`` (key, size, ...) with ``shard``: rows of one key share it, bytes are near equal."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(shards * bundles)).cast("int"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy_at = max(1, -(-total // (shards * fine)))
    weighty = F.col("bytes") >= heavy_at
    found = (
        groups.groupBy(F.when(weighty, F.col("key")).alias("key"), F.when(~weighty, F.col("bundle")).alias("bundle"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )  # at most shards * (fine + bundles) rows
    place = lpt([(r["bytes"], ("k", bytes(r["key"])) if r["key"] is not None else ("b", r["bundle"])) for r in found], shards)
    heavy = [(k, s) for (kind, k), s in place.items() if kind == "k"]
    light = [(k, s) for (kind, k), s in place.items() if kind == "b"]
    heavy = spark.createDataFrame(heavy, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("heavy_shard", T.IntegerType())]))
    light = spark.createDataFrame(light, T.StructType([T.StructField("bundle", T.IntegerType()), T.StructField("light_shard", T.IntegerType())]))
    return (
        rows.withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(shards * bundles)).cast("int"))
        .join(F.broadcast(heavy), "key", "left")
        .join(F.broadcast(light), "bundle", "left")
        .withColumn("shard", F.coalesce("heavy_shard", "light_shard"))
        .drop("bundle", "heavy_shard", "light_shard")
    )


def slotted(rows: DataFrame, lanes: int = 64) -> DataFrame:
    """Gapless ``slot`` from 0 within each shard. A shard's rows are numbered in ``lanes`` parts, so no
    task holds a whole shard; the ``shards * lanes`` part sizes give each part its first number."""
    laned = rows.withColumn("lane", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(lanes)).cast("int"))
    w = Window.partitionBy("shard").orderBy("lane")
    # one small row for each shard and lane
    first = laned.groupBy("shard", "lane").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(w) - F.col("n")).drop("n")
    own = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")
    return (
        laned.withColumn("nth", F.row_number().over(own) - 1)
        .join(F.broadcast(first), ["shard", "lane"])
        .withColumn("slot", F.col("first") + F.col("nth"))
        .drop("lane", "nth", "first")
    )


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    return slotted(schedule(cut(weighed(docs, id_col, text_col), "weighed"), shards))


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
