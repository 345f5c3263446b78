"""Sharding: global byte-size prefix sums cut at equal targets (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, shuffle_partitions


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards in id order whose byte sizes are near equal.

    Rows are ordered by id, then by the text's checksum and size; null ids come first, repeated rows
    are interchangeable and each gets its own slot. A row goes to the shard in which the middle of its
    bytes lies, so that a shard misses its target by half a row at each end at most. A null text has no
    bytes. An empty table gives an empty result. Other columns are ignored, whatever their names.

    Only (id, size, checksum) is shuffled: once by range into sorted blocks, once so that each block is
    one window partition. What is broadcast has a row per block or per shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"))  # equal rows spread over blocks
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("tie")]
    n = shuffle_partitions(spark)
    blocks = scratch.write(narrow.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), "blocks")
    totals = blocks.groupBy("block").agg(F.sum("size").alias("block_bytes"), F.count("*").alias("block_rows"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    totals = totals.select("block", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("block_bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("block").orderBy(*order)
    summed = (
        blocks.repartitionByRange(n, "block")
        .withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "block")
    )
    twice_middle = 2 * (F.col("bytes_before") + F.col("end")) - F.col("size")
    summed = summed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth")).alias("nth"), twice_middle.cast("decimal(20,0)").alias("twice"), "all_bytes")
    shard = F.least(F.expr(f"cast(twice * {shards} div (2 * all_bytes) as int)"), F.lit(shards - 1))  # whole numbers: exact at any size
    placed = scratch.write(summed.select("doc_id", "size", "text_crc32", "nth", shard.alias("shard")), "placed")
    starts = placed.groupBy("shard").agg(F.min("nth").alias("first_nth"))
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first_nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
