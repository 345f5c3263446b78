"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Scratch, join_facts, lower_ascii, row_key, shuffle_partitions


class RunStore:
    """Sorted runs (key, n, first): of each key that a batch added, how many documents hold the line up to this batch,
    and the first of them by batch and id. A key's newest run has its whole count. Runs are tables bucketed and sorted by
    key, so that a batch, dealt and sorted in the same way, merges with all of them without an exchange or a sort. As
    soon as a level has `fanout` runs they are merged into one of the next."""

    def __init__(self, scratch: Scratch, saturated: int, fanout: int, buckets: int):
        self.scratch, self.saturated, self.fanout, self.buckets, self.levels, self.made = scratch, saturated, fanout, buckets, [[]], 0
        scratch.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # readers know that runs are sorted

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _put(self, level: int, run: DataFrame, dealt: bool) -> None:
        self.made += 1
        name = f"run{self.made}"
        self.levels[level].append((name, self.scratch.bucketed(run, name, self.buckets, "key", dealt=dealt)))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-joins the batch's keys with the saturated keys of all runs, adds the counts that the runs have of
        the others, and writes these as a run."""
        held = self.runs()
        for run in held:
            batch = batch.join(run.filter(F.col("n") >= self.saturated).select("key").hint("merge"), "key", "left_anti")
        for k, run in enumerate(held if self.saturated > 1 else []):
            batch = batch.join(run.select("key", F.col("n").alias(f"n{k}"), F.col("first").alias(f"first{k}")).hint("merge"), "key", "left")
        if held and self.saturated > 1:
            prior = F.greatest(F.lit(0).cast("long"), *(F.col(f"n{k}") for k in range(len(held))))
            batch = batch.select("key", (F.col("n") + prior).alias("n"), F.least("first", *(F.col(f"first{k}") for k in range(len(held)))).alias("first"))
        self._put(0, batch, bool(held))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(DataFrame.unionByName, (run for _, run in old)).groupBy("key").agg(F.max("n").alias("n"), F.min("first").alias("first"))
            self._put(level + 1, merged, True)
            self.scratch.drop(*(name for name, _ in old))
            level += 1

    def frequent(self) -> DataFrame:
        """The saturated keys; each is so in one run only."""
        return reduce(DataFrame.unionByName, self.runs()).filter(F.col("n") >= self.saturated)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 9, fanout: int = 3, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, the text without its repeated lines, and __lq_lines and __lq_dropped (line counts).

    Lines end at \\n; a null or empty text is one empty line and comes back empty. A line's key is the
    line without white space at both ends, A-Z in lower case. Keys of min_chars code points or more that
    are in min_docs documents or more lose all their lines. Each row counts as a document, repeated rows
    and rows with null ids too. Input columns keep their names; an empty table gives an empty result.

    Documents are dealt into batches. Each batch's keys are counted once per document and pre-aggregated;
    a key that the runs hold as frequent isn't counted again, so that hot lines add nothing. Frequent keys
    go back to the documents' line positions, and only these positions meet the texts (in a broadcast, if Spark
    finds them small enough, else in one exchange of the texts)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    r1, r2 = row_key(F.col(id_col), F.col(text_col))
    keys = F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.when(F.char_length(F.btrim(x, F.lit(SPACE))) >= min_chars, F.md5(F.btrim(x, F.lit(SPACE)))).otherwise(F.lit("")))
    hashed = scratch.write(docs.select(F.col(id_col).alias("id"), r1.alias("r1"), r2.alias("r2"), keys.alias("keys")), "keys")
    seen = hashed.select("id", F.pmod("r2", F.lit(batches)).cast("int").alias("batch"), F.explode(F.array_distinct("keys")).alias("key")).filter("key <> ''")
    buckets = shuffle_partitions(docs.sparkSession)
    counted = seen.groupBy("batch", F.unhex("key").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    counted = scratch.bucketed(counted, "counted", buckets, "key", by=["batch"])
    store = RunStore(scratch, min_docs, fanout, buckets)
    for k in range(batches):
        store.add(counted.filter(F.col("batch") == k).select("key", "n", F.struct("batch", "id").alias("first")))
    frequent = scratch.write(store.frequent(), "frequent")
    total = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = hashed.select("id", "r1", "r2", F.posexplode("keys").alias("pos", "hex")).filter("hex <> ''").select("id", "r1", "r2", "pos", F.unhex("hex").alias("key"))
    hits = join_facts(lines, frequent, ["key"], "n", total)
    if keep_first:
        hits = hits.filter(~F.col("first.id").eqNullSafe(F.col("id")))
    gone = scratch.write(hits.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("__lq_gone")).withColumnsRenamed({"r1": "__lq_r1", "r2": "__lq_r2"}), "gone")
    scratch.drop("keys", "counted")
    lost = F.coalesce(F.col("__lq_gone"), F.array().cast("array<int>"))
    split = F.split(text, "\n", -1)
    at = lambda i: F.when(i < 0, F.lit(-1)).when(i >= F.size(lost), F.size(split)).otherwise(F.get(lost, i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(lost)), lambda i: F.slice(split, at(i - 1) + 2, at(i) - at(i - 1) - 1)))
    joined = docs.withColumns({"__lq_r1": r1, "__lq_r2": r2}).join(gone, ["__lq_r1", "__lq_r2"], "left")
    return joined.select(
        *(F.when(F.col("__lq_gone").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.size(split).cast("long").alias("__lq_lines"), F.size(lost).cast("long").alias("__lq_dropped"),
    )
