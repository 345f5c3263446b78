"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The vocabulary's own split of lower-case text, for the characters that _PLAIN allows.
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
#: Texts with other characters, or with the string of a special token, are encoded whole by the library.
_OTHER = re.compile("[^\t-\r -~\x80-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]|<\\|")
_CACHE: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def byte_letters() -> str:
    """By byte, the character that stands for it in a byte-level vocabulary: printable ones for themselves,
    the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class WordTokenizer:
    """Token ids as little-endian uint32 bytes. No token spans two words of the vocabulary's own split, and
    no word spans white space: ids are looked up by chunk between white space, then by word, in caches of
    bounded size, and only new words go through the library's model."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache_entries
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.chunks, self.words = _CACHE.setdefault(path, ({}, {}))

    def _word(self, word: str) -> bytes:
        key = word
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        found = np.array([t.id for t in self.model.tokenize(word)], dtype="<u4").tobytes()
        if len(self.words) >= self.most:
            self.words.clear()
        self.words[key] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        known = self.words
        found = b"".join([known.get(w) or self._word(w) for w in _SPLIT.findall(chunk)])
        if len(self.chunks) >= self.most:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known, new = self.chunks.get, self._chunk
        return b"".join([known(c) or new(c) for c in text.lower().split()])


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it starts in its document's ids, its length and its ids' CRC-32. Only
    documents longer than `capacity` are cut. A null text is empty and still has its end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, placed one by one: of all gaps that are open and large enough, and
    of opening a bin, the choice after which the sum of the squared counts of open bins per gap is
    smallest. Equal choices: the smaller gap, a new bin last."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            best, gap = -1, capacity
        else:
            # by gap g from s: 2 (count[g - s] - count[g] + 1); a full bin has no gap, so it isn't counted
            open_gaps = np.flatnonzero(count[s:capacity])
            gap, best = capacity, 2 * count[capacity - s] + 1
            if len(open_gaps):
                change = 2 * (count[open_gaps] - count[open_gaps + s] + 1)
                if open_gaps[0] == 0:
                    change[0] = 1 - 2 * count[s]
                at = int(change.argmin())
                if change[at] <= best:
                    gap = int(open_gaps[at]) + s
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 4096, group: int = 250_000) -> DataFrame:
    """pieces with sequence_id and offset. Each task packs `group` pieces in a mixed order, which the rule
    fills better than a sorted one; what stays open is small against so many sequences."""
    names = pieces.columns
    n = pieces.count()
    groups = max(1, math.ceil(n / group))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        order = np.random.default_rng(7).permutation(len(lengths))
        bins, offsets = (np.empty(len(lengths), dtype=np.int64) for _ in range(2))
        bins[order], offsets[order] = sum_of_squares(lengths[order], capacity)
        base = TaskContext.get().partitionId() << 40
        yield from table.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).to_batches(50_000)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return pieces.repartition(groups).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens; one row per piece.

    Null and empty texts are pieces of one token (the end id). Repeated rows are packed like others; a
    null id stays null. An empty table gives an empty result. Other columns are ignored. Pieces, not
    texts, are written and shuffled."""
    scratch = Scratch(docs.sparkSession)
    return pack(scratch.write(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), scratch, capacity)
