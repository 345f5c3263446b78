"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")


def shingles(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    """The distinct runs of `width` words; a shorter text is one run."""
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


@dataclass
class Item:
    item_id: int
    question: set
    answer: set

    def overlap(self, passage: set) -> tuple[float, float, float]:
        """Shares of all shingles, of the question's and of the answer's (1 where there is none) in the passage."""
        share = lambda part: len(part & passage) / len(part) if part else 1.0
        return share(self.question | self.answer), share(self.question), share(self.answer)


class ItemIndex:
    """Postings of normalised BM25 weights, in blocks with their maxima.

    Weights of an item are divided by the least score that a passage holding `threshold` of the item's
    shingles can have: each missing shingle costs one word at most, so the item's heaviest words are
    taken off. A passage is retrieved for an item at a score of 1 or more, and none that could pass
    verification is lost."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.8, width: int = 5, k1: float = 1.2, b: float = 0.75, block: int = 16):
        self.threshold, self.width = threshold, width
        parsed = []
        for item_id, text in items:
            parts = [p for p in _SENTENCE.split(text.lower()) if _WORD.search(p)]
            if parts:
                words = _WORD.findall(text.lower())
                tail = _WORD.findall(parts[-1]) if len(parts) > 1 else []
                parsed.append((item_id, words, len(words) - len(tail)))
        df = Counter(w for _, words, _ in parsed for w in set(words))
        common = lambda words: sorted(set(words), key=lambda w: (-df[w], w))[:6]
        parsed.sort(key=lambda x: (common(x[1]), x[0]))  # items alike stand in the same blocks
        self.longest = max((len(w) for _, w, _ in parsed), default=1)
        mean = sum(len(w) for _, w, _ in parsed) / max(1, len(parsed))
        self.items: list[Item] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (item_id, words, cut) in enumerate(parsed):
            full = shingles(words, width)
            # a run across question and answer counts as the answer's, but as the question's if that has no run of its own
            head = shingles(words[:cut] if cut >= width else words[: cut + width - 1], width)
            tail = full - head or shingles(words[max(0, cut - width + 1) :], width)
            self.items.append(Item(item_id, head, tail if cut < len(words) else set()))
            weight = {w: math.log(1 + (len(parsed) - df[w] + 0.5) / (df[w] + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / mean)) for w, n in Counter(words).items()}
            missing = math.floor((1 - threshold) * len(full) + 1e-9) if len(words) >= width else 0
            heavy = sorted(weight.values(), reverse=True)
            least = max(sum(heavy[missing:]), 1e-9)
            for w, x in weight.items():
                postings[w].append((k, x / least + 1e-12))
        self.terms = {w: t for t, w in enumerate(sorted(postings))}
        self.lists, self.blocks = [], []
        for w in self.terms:
            ids, weights = [p[0] for p in postings[w]], [p[1] for p in postings[w]]
            self.lists.append((ids, weights))
            self.blocks.append([(ids[min(i + block, len(ids)) - 1], max(weights[i : i + block])) for i in range(0, len(ids), block)])
        # an item's rarest words, so many that the others together score under a half
        self.needed, needed = np.zeros(len(parsed)), defaultdict(list)
        by_item: list[list[tuple[int, str, float]]] = [[] for _ in parsed]
        for w, listed in postings.items():
            for k, x in listed:
                by_item[k].append((df[w], w, x))
        for k, words in enumerate(by_item):
            rest = sum(x for _, _, x in words)
            for _, w, x in sorted(words):
                if rest < 0.5:
                    break
                rest -= x
                needed[self.terms[w]].append((k, x))
            self.needed[k] = 1.0 - rest - 1e-9
        self.rare_cut = np.concatenate([[0], np.cumsum([len(needed[t]) for t in range(len(self.terms))])]).astype(np.int64)
        self.rare_item = np.array([k for t in range(len(self.terms)) for k, _ in needed[t]], dtype=np.int64)
        self.rare_weight = np.array([x for t in range(len(self.terms)) for _, x in needed[t]])
        self.most = [max(w for _, w in b) for b in self.blocks]
        self.block = block

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a score of 1 or more for the set of terms, by block-max WAND: the pivot is the first
        item that the terms' maxima allow to score enough; it is scored only if its blocks' maxima allow it
        too, else the cursors skip to the end of the shallowest block."""
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # item, position, term
        found, end, block = [], len(self.items), self.block

        def seek(c: list, item: int) -> None:
            ids, at = self.lists[c[2]][0], c[1]
            blocks, k = self.blocks[c[2]], c[1] // block
            while k < len(blocks) and blocks[k][0] < item:
                k += 1
            at = max(at, k * block)
            while at < len(ids) and ids[at] < item:
                at += 1
            c[0], c[1] = (ids[at], at) if at < len(ids) else (end, at)

        while True:
            cursors.sort(key=lambda c: c[0])
            upper, p = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                upper += self.most[c[2]]
                if upper >= 1.0:
                    p = k
                    break
            if p < 0:
                return found
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            local, border = 0.0, end
            for c in cursors[: p + 1]:
                blocks, k = self.blocks[c[2]], c[1] // block
                while k < len(blocks) and blocks[k][0] < pivot:
                    k += 1
                if k < len(blocks):
                    local += blocks[k][1]
                    border = min(border, blocks[k][0] + 1)
            if local >= 1.0:
                score = 0.0
                for c in cursors[: p + 1]:
                    seek(c, pivot)
                    if c[0] == pivot:
                        score += self.lists[c[2]][1][c[1]]
                        seek(c, pivot + 1)
                if score >= 1.0:
                    found.append((pivot, score))
            else:
                onward = max(pivot + 1, min(border, cursors[p + 1][0] if p + 1 < len(cursors) else end))
                for c in cursors[: p + 1]:
                    seek(c, onward)

    def find(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float, float]]]:
        """By text: of each item found in one of its passages (item_id to score, overlaps), from the passage
        with most of it. Passages are two neighbouring runs of as many words as the longest item has."""
        step, n_terms = max(32, self.longest), len(self.terms)
        words = [_WORD.findall(t.lower()) if t else [] for t in texts]
        out: list[dict] = [{} for _ in texts]
        chunks = [max(1, math.ceil(len(w) / step)) for w in words]
        first = np.concatenate([[0], np.cumsum(chunks)])
        flat = np.fromiter((t for w in words for t in map(self.terms.get, w, repeat(n_terms))), dtype=np.int64, count=sum(map(len, words)))
        sizes = [len(w) for w in words]
        within = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        chunk = np.repeat(first[:-1], sizes) + within // step
        known = flat < n_terms
        pairs = np.unique(chunk[known] * n_terms + flat[known])
        chunk, term = pairs // max(1, n_terms), pairs % max(1, n_terms)
        cut = np.searchsorted(chunk, np.arange(first[-1] + 1))
        doc_of = np.repeat(np.arange(len(texts)), chunks)
        follows = np.append(doc_of[1:] == doc_of[:-1], False)
        # scores of rare words alone: a passage can reach an item only if they make up what the others can't
        width = self.rare_cut[term + 1] - self.rare_cut[term]
        place = np.repeat(self.rare_cut[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
        start = np.repeat(chunk, width)
        back = (start > 0) & follows[np.maximum(start - 1, 0)]
        keys = np.concatenate([start, start[back] - 1]) * max(1, len(self.items)) + np.concatenate([self.rare_item[place], self.rare_item[place][back]])
        reached, at = np.unique(keys, return_inverse=True)
        score = np.bincount(at, weights=np.concatenate([self.rare_weight[place], self.rare_weight[place][back]]), minlength=len(reached))
        able = score >= self.needed[reached % max(1, len(self.items))] if len(reached) else np.zeros(0, bool)
        for c in np.unique(reached[able] // max(1, len(self.items))).tolist():
            d = int(doc_of[c])
            near = np.unique(term[cut[c] : cut[c + 1 + bool(follows[c])]]).tolist()
            hits = self.retrieve(near)
            if hits:
                at = (c - int(first[d])) * step
                passage = shingles(words[d][at : at + 2 * step], self.width)
                if any(len(i.question | i.answer) == 1 for i in (self.items[k] for k, _ in hits)):
                    part = words[d][at : at + 2 * step]
                    passage |= {tuple(part[i : i + n]) for n in range(1, self.width) for i in range(len(part) - n + 1)}
                for k, score in hits:
                    overlap = self.items[k].overlap(passage)
                    if overlap[0] >= self.threshold - 1e-9:
                        key = self.items[k].item_id
                        out[d][key] = max(out[d].get(key, (0.0,) * 4), (overlap[0], score, *overlap[1:]))
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_items: int, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of about max_items items and max_bytes bytes, one after the other on the driver."""
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / max_items), math.ceil(size / max_bytes))
    for k in range(blocks):
        yield [(r.id, r.text) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]


def _batches(column: pa.Array, step: int = 128) -> Iterator[tuple[int, list]]:
    for at in range(0, len(column), step):
        yield at, column.slice(at, step).to_pylist()


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, max_items: int = 10_000, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, bm25, overlap, question_overlap, answer_overlap, question_held, answer_held): a passage of
    the document holds at least `threshold` of the item's shingles of `width` words. bm25 is relative to the least
    score that such a passage can have. An item's answer is its last sentence, if it has several. Question and answer
    are verified each by itself, too: held tells whether the passage has `threshold` of that part. A passage that is
    near enough to the whole item counts all the same, for a word changed in a short answer undoes most of its runs.

    Every passage is a query. Those that have too little of each item's rarest words to score enough, whatever else they
    hold, are told apart by a sum over these words' postings; block-max WAND retrieves for all others.

    Null texts and texts or items without words match nothing. Items shorter than `width` words match as a
    run. Every document is searched whole; repeated rows give rows of their own. Items are indexed in blocks
    of bounded size, each broadcast in turn; no document is shuffled. Empty tables give an empty result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in item_blocks(items, item_id_col, item_text_col, max_items, max_bytes):
        shared = spark.sparkContext.broadcast(ItemIndex(block, threshold, width))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                ids = batch.column(0).to_pylist()
                for at, texts in _batches(batch.column(1)):
                    for i, hits in enumerate(shared.value.find(texts)):
                        found += [(ids[at + i], item, score, whole, q, a, q >= threshold - 1e-9, a >= threshold - 1e-9) for item, (whole, score, q, a) in hits.items()]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 8, types)], names=["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap", "question_held", "answer_held"])

        part = rows.mapInArrow(search, "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double, question_held boolean, answer_held boolean")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, max_items: int = 10_000, max_bytes: int = 16 << 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows in which find_contamination finds no item; columns unchanged."""
    spark, schema, place = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col, max_items, max_bytes):
        shared = spark.sparkContext.broadcast(ItemIndex(block, threshold, width))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = [not hits for _, texts in _batches(batch.column(place)) for hits in shared.value.find(texts)]
                yield batch.filter(pa.array(mask, pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
