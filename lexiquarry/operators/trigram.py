"""The trigram index: postings of three-byte windows of the lower-cased content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of an index: the most bytes of content and files that one is cut from (a longer file is one by itself), and its rows.
BLOCK_BYTES, BLOCK_FILES = 4 << 20, 1 << 15
BLOCKS = "repo_id string, tri binary, first long, docs array<smallint>"


def query_trigrams(query: str) -> list[bytes] | None:
    """The distinct windows of the lower-cased query; None if the index can't serve it: under three bytes, or
    with a sigma, whose lower case depends on where the word ends."""
    text = query.lower().encode("utf-8", "surrogatepass")
    if len(text) < 3 or any(c in query for c in "Σσς"):
        return None
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def postings(files: DataFrame) -> DataFrame:
    """(repo_id, tri, doc_id), distinct, of files (repo_id, doc_id, content). Content under three bytes has none.

    Windows are cut from the binary content, where a window costs the same anywhere. Windows span lines:
    a query with a line break finds candidates, though no line."""
    lower = F.lower(F.col("content").cast("string")).cast("binary")
    bodies = files.select("repo_id", "doc_id", lower.alias("body")).filter(F.octet_length("body") >= 3)
    windows = F.transform(F.sequence(F.lit(1), F.octet_length("body") - 2), lambda i: F.substring("body", i, F.lit(3)))
    return bodies.select("repo_id", F.explode(windows).alias("tri"), F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _block(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (window, place of its body), by window; windows are numbers of three bytes."""
    if len(bodies) == 1 and len(bodies[0]) > BLOCK_BYTES:
        held = np.zeros(1 << 24, dtype=bool)
        for at in range(0, len(bodies[0]) - 2, BLOCK_BYTES):
            held[_windows(bodies[0][at : at + BLOCK_BYTES + 2])] = True
        found = np.flatnonzero(held)
        return found, np.zeros(len(found), np.int64)
    key = np.concatenate([(_windows(b) << 15) | i for i, b in enumerate(bodies)])
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return key >> 15, key & (BLOCK_FILES - 1)


def _windows(body: np.ndarray) -> np.ndarray:
    wide = body.astype(np.int64)
    return (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]


def posting_blocks(files: DataFrame) -> DataFrame:
    """BLOCKS of files (repo_id, doc_id, content), whose doc_ids are unique in a repository: for each window the files of
    a block that hold it, ascending, as distances from `first`. Each file is read once, where it is; nothing is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repos, ids = batch.column(0), batch.column(1).to_numpy()
            held, size = [], 0
            for k in range(batch.num_rows + 1):
                body = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8) if k < batch.num_rows else None
                done = body is None or len(held) and (size + len(body) > BLOCK_BYTES or len(held) == BLOCK_FILES or abs(ids[k] - ids[held[0][0]]) >= BLOCK_FILES // 2 or repos[k] != repos[held[0][0]])
                if done and held:
                    yield made(repos[held[0][0]], ids, sorted(held, key=lambda x: ids[x[0]]))
                    held, size = [], 0
                if body is not None:
                    held.append((k, body))
                    size += len(body)

    def made(repo: pa.Scalar, ids: np.ndarray, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        first = ids[held[0][0]]
        tri, at = _block([b for _, b in held])
        starts = np.flatnonzero(np.diff(tri, prepend=-1))
        tri, n = tri[starts], len(starts)
        docs = (ids[[k for k, _ in held]] - first).astype(np.int16)[at]
        names = np.stack([tri >> 16, (tri >> 8) & 255, tri & 255], axis=1).astype(np.uint8)
        columns = [
            pa.repeat(repo, n), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 3 * n + 1, 3, dtype=np.int32)), pa.py_buffer(names)]),
            pa.array(np.full(n, first, np.int64)), pa.ListArray.from_arrays(pa.array(np.append(starts, len(docs)).astype(np.int32)), pa.array(docs)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["repo_id", "tri", "first", "docs"])

    lower = F.lower(F.col("content").cast("string")).cast("binary")
    bodies = files.select("repo_id", F.col("doc_id").cast("long").alias("doc_id"), lower.alias("body")).filter(F.octet_length("body") >= 3)
    return bodies.mapInArrow(cut, BLOCKS)


def unblocked(blocks: DataFrame) -> DataFrame:
    """(repo_id, tri, doc_id) of BLOCKS. A filter on windows comes before any list is opened."""
    ids = F.transform("docs", lambda d: F.col("first") + d)
    return blocks.select("repo_id", "tri", F.explode(ids).alias("doc_id"))


def posting_lists(index: DataFrame) -> DataFrame:
    """(repo_id, tri, doc_ids), ascending. For reports; searches read the long form."""
    return index.groupBy("repo_id", "tri").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def candidates(index: DataFrame, query: str) -> DataFrame:
    """(repo_id, doc_id) of files that hold every window of the query."""
    wanted = query_trigrams(query)
    if wanted is None:
        raise ValueError("the index can't serve this query")
    hit = index.filter(F.col("tri").isin([F.lit(bytearray(t)) for t in wanted]))
    return hit.groupBy("repo_id", "doc_id").agg(F.count("tri").alias("n")).filter(F.col("n") == len(wanted)).select("repo_id", "doc_id")


def index_stats(index: DataFrame) -> DataFrame:
    """Distinct windows, postings, and bytes of the delta-varint form of the posting lists."""
    from pyspark.sql import Window

    before = F.lag("doc_id", 1, -1).over(Window.partitionBy("repo_id", "tri").orderBy("doc_id"))
    gap = F.col("doc_id") - F.when(before < 0, 0).otherwise(before)
    width = F.greatest(F.lit(1), F.ceil(F.length(F.bin(gap)) / 7))
    return index.withColumn("bytes", width).agg(F.count_distinct("tri").alias("n_trigrams"), F.count("*").alias("n_postings"), F.sum("bytes").cast("long").alias("n_bytes"))
