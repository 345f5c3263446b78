"""Exact dedup by two-pass Bloom filtering (DataFrame functions only)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_facts, lower_ascii

#: Bits of one bitmap of bitmap_construct_agg (a fixed value of that function).
BITMAP = 32768


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.expr("0") + F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)), F.lit(0)) == 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 32, max_filter_bits: int = 1 << 30) -> DataFrame:
    """Per row: keep_id (the largest id with this text), group_size, kept and the text's sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of rows with equal
    text and equal largest id exactly one is kept; a null id is smaller than any other. Other columns
    are ignored, whatever their names; an empty table gives an empty result.

    Pass 1 counts how often each cell of a Bloom filter is hit, one cell a row: tasks sum up their own rows, the sums
    meet by cell (a cell's number and a count a row, no digest), and the cells hit twice or more become bitmaps.
    Pass 2 probes them: a row with a cell of its own is unique and passes straight through; only rows that may be
    repeated are shuffled by digest, pre-aggregated, and joined back (hot groups by a broadcast of bounded size). At 32
    cells a row 3 in 100 unique rows are taken for repeated ones at first. A filter over max_filter_bits is cut by
    cells into slices, each broadcast to its own rows, max_filter_bits / 8 bytes at most at a time."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.write(narrow, "all")
    words = max(1, math.ceil(rows.count() * bits_per_row / BITMAP))
    cell = F.pmod(F.xxhash64("sha"), F.lit(words * BITMAP))
    word = F.floor(cell / BITMAP)  # exact: cells are far below 2**53
    hit_twice = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter("n > 1")
    bloom = scratch.write(hit_twice.groupBy(F.floor(F.col("cell") / BITMAP).alias("word")).agg(F.bitmap_construct_agg(F.col("cell") % BITMAP).alias("map")), "bloom")
    per_slice = max(1, max_filter_bits // BITMAP)
    slices = math.ceil(words / per_slice)
    if slices > 1:
        rows = scratch.write(rows.withColumn("slice", F.floor(word / per_slice).cast("int")), "sliced", "slice")
    probed = []
    for k in range(slices):
        own = rows.filter(F.col("slice") == k) if slices > 1 else rows
        held = bloom.filter(F.col("word").between(k * per_slice, (k + 1) * per_slice - 1))
        own = own.withColumn("word", word).join(F.broadcast(held), "word", "left")
        probed.append(own.select("doc_id", "sha", "rid", _bit(F.col("map"), cell % BITMAP).alias("maybe")))
    probed = reduce(DataFrame.unionByName, probed)
    once = probed.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    many = scratch.write(probed.filter("maybe").drop("maybe"), "maybe")
    groups = scratch.write(many.groupBy("sha").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    joined = join_facts(many, groups, ["sha"], "group_size", many.count())
    return once.unionByName(joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))
