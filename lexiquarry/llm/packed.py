"""Numbers and bytes packed into binary values, and rows of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack_bytes(data: bytes) -> bytes:
    """Bytes compressed once, so that they stay small in tables and exchanges; whoever unpacks them knows their size."""
    return pa.compress(data, codec="zstd", asbytes=True)


def unpack_bytes(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_lanes(x: np.ndarray) -> bytes:
    """Numbers by byte, all first bytes, all second bytes and so on: those that are alike compress well."""
    return pack_bytes(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack_lanes(data: bytes, n: int, dtype: type) -> np.ndarray:
    raw = np.frombuffer(unpack_bytes(data, n * np.dtype(dtype).itemsize), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(dtype).ravel() if n else np.zeros(0, dtype)


def pack_rising(x: np.ndarray) -> bytes:
    """Numbers in order, as their differences."""
    return pack_lanes(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpack_rising(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_lanes(data, n, np.uint64), dtype=np.uint64)


def pack_bits(x: np.ndarray) -> bytes:
    return pack_bytes(np.packbits(x).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack_bytes(data, -(-n // 8)), np.uint8), count=n).astype(bool)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def to_batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.values())], names=list(schema))


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def arrow_schema(text: str) -> dict[str, pa.DataType]:
    return {name: _TYPES[kind] for name, kind in (part.split() for part in text.split(", "))}


def deal(frame: DataFrame, buckets: int) -> DataFrame:
    """The rows of each bucket, by number, in a partition of their own."""
    return frame.repartitionById(buckets, F.col("bucket")) if hasattr(frame, "repartitionById") else frame.repartition(buckets, "bucket")
