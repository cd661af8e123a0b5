"""Operator 8: contiguous shards of near-equal bytes by global prefix sums.

Rows are reduced to (key, size, crc) where they are read, dealt by ranges of the key and sorted
within each range. Per-range totals (one row a range) are summed up into offsets; a row's
global start is its range's offset plus a running sum inside the range. A row belongs to the
shard in which its middle byte falls when the whole is cut at equal targets. DataFrame
functions only.

Null text has 0 bytes (size 16) and crc 0. Repeated rows keep their own places, next to each
other; a null key sorts first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Bytes that each row costs besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    spark, bin_ = docs.sparkSession, []
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = ["doc_id", "text_crc32", "size"]
    ranged = rows.repartitionByRange(common.partitions(spark), *key).sortWithinPartitions(*key).withColumn("pid", F.spark_partition_id())
    ranged = common.settle(ranged, "ranged", bin_)
    inside = Window.partitionBy("pid").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("pid").agg(F.sum("size").alias("b"), F.count("*").alias("n"))  # one row a range
    whole = totals.agg(F.sum("b").alias("all_bytes"))
    offsets = totals.select("pid", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")).crossJoin(F.broadcast(whole))  # a single row
    placed = ranged.withColumn("b1", F.sum("size").over(inside)).withColumn("i1", F.count("*").over(inside)).join(F.broadcast(offsets), "pid")
    placed = placed.select(*key, F.least(F.lit(shards - 1), F.expr(f"cast(floor((2 * (b0 + b1) - size) * cast({shards} as decimal(20,0)) / (2 * all_bytes)) as int)")).alias("shard"), (F.col("n0") + F.col("i1") - 1).alias("place"))
    placed = common.settle(placed, "placed", bin_)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most `shards` rows
    out = placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    return common.final(out, "shards", bin_)

