"""Removal of repeated byte strings by a difference cover: of every fixed-width string, all but the smallest
document's are cut.

A cover of period v holds, for any two places, an offset below v that takes both to sampled places. Only the
tuples at sampled places are sorted and named; names found in one document are dropped, for they start no repeated
string; the names left are named again in pairs a period apart, which settles the inside of repeated passages;
and what is left, the strings at the passages' edges, is merged by sampled place and compared byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import _BYTES, _STEP, _powers, mix
from .packed import arrow_schema, deal, each_row, pack_bits, pack_bytes, pack_lanes, pack_rising, to_batch, unpack_bits, unpack_bytes, unpack_lanes, unpack_rising
from .shared import Scratch, shuffle_partitions

LEAST = -(1 << 63)
#: Bytes of text in a block (a longer document is a block of its own), hashed at a time, and dealt to a bucket on average.
BLOCK, SLICE, SHARE = 1 << 22, 1 << 20, 1 << 24
#: Perfect difference sets by their period; any two residues differ by a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: A second table of random bytes, for names of more than 64 bits.
_OTHER = mix(np.arange(1001, 1257, dtype=np.uint64) * _STEP)


class Cover:
    """The longest period that leaves two fifths of the width, or nearly, to the sampled tuples."""

    def __init__(self, width: int):
        self.width, self.period = width, max(v for v in COVERS if 5 * v <= 3 * width + 5 or v == 1)
        self.tuple = width - self.period + 1
        self.sampled = np.isin(np.arange(self.period), COVERS[self.period])


class Block:
    """Texts of some documents in order of their ids, in one buffer."""

    def __init__(self, ids: list[int | None], sizes: list[int], text: bytes):
        self.buf = np.frombuffer(unpack_bytes(text, sum(sizes)), dtype=np.uint8)
        self.size = np.array(sizes, dtype=np.int64)
        self.ends = np.cumsum(self.size)
        self.ord = np.array([LEAST if i is None else i for i in ids], dtype=np.int64)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The documents of some places."""
        return np.searchsorted(self.ends, at, "right")

    def places(self, cover: Cover) -> np.ndarray:
        """Sampled places, counted from each document's start, that a whole tuple follows."""
        start = np.repeat(self.ends - self.size, self.size)
        at = np.arange(len(self.buf))
        good = cover.sampled[(at - start) % cover.period]
        good &= at + cover.tuple <= np.repeat(self.ends, self.size)
        return np.flatnonzero(good)

    def hashes(self, at: np.ndarray, length: int | np.ndarray, table: np.ndarray = _BYTES) -> np.ndarray:
        """Hashes of the strings of some lengths at some places, which are in order."""
        out, most = np.empty(len(at), np.uint64), int(np.max(length, initial=0))
        for lo in range(0, len(self.buf), SLICE):
            i, j = np.searchsorted(at, (lo, lo + SLICE))
            if i < j:
                part = self.buf[lo : lo + SLICE + most]
                up, down = _powers(len(part) + 1)
                summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)])])
                first, n = at[i:j] - lo, length if isinstance(length, int) else length[i:j]
                out[i:j] = mix((summed[first + n] - summed[first]) * down[first])
        return out


class Groups:
    """Equal keys: the order by key, each key's first and last place (documents are in order of their ids), and the
    group of each place. check: a second key, held against the first one's neighbours."""

    def __init__(self, key: np.ndarray, check: np.ndarray | None = None):
        order = np.argsort(key)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        if check is not None:
            new[1:] |= check[order][1:] != check[order][:-1]
        starts = np.flatnonzero(new)
        self.first = np.minimum.reduceat(order, starts) if len(starts) else order
        self.last = np.maximum.reduceat(order, starts) if len(starts) else order
        self.of = np.empty(len(key), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1


#: What a block sends to a bucket: so many keys in order, the block's keys before them, and facts of the keys;
#: or, with `bucket` -1, what the block's next step needs. What a bucket answers: up to two facts of each of these keys.
SENT = "bucket int, block long, base int, n int, keys binary, facts binary, more binary, kind int"
ANSWERED = "block long, base int, n int, yes binary, also binary"


def _dealt(keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of the ranges that hold some of the keys, which are in order and have so many bits."""
    bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield k, int(cuts[k]), int(cuts[k + 1])


class Bucket:
    """All keys that blocks have sent to a bucket, merged: the order by key and where each group begins."""

    def __init__(self, found: list[tuple], check: list[np.ndarray] | None = None):
        self.found, self.sizes = found, [x[2] for x in found]
        key = np.concatenate([unpack_rising(x[3], x[2]) for x in found])
        self.order = np.argsort(key, kind="stable")  # merges the blocks' sorted runs
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[self.order][1:] != key[self.order][:-1]
        if check is not None:
            second = np.concatenate(check)[self.order]
            new[1:] |= second[1:] != second[:-1]
        self.starts = np.flatnonzero(new)
        self.counts = np.diff(np.append(self.starts, len(key)))

    def column(self, parts: Iterator[np.ndarray]) -> np.ndarray:
        return np.concatenate(list(parts))[self.order]

    def least_of_others(self, x: np.ndarray) -> np.ndarray:
        """By place in the order, the least of the group's other values."""
        nth = np.repeat(np.arange(len(self.starts)), self.counts)
        least = np.minimum.reduceat(x, self.starts)[nth]
        rest = np.where(x == least, np.iinfo(x.dtype).max, x)
        second = np.minimum.reduceat(rest, self.starts)[nth]
        alone = np.add.reduceat((x == least).astype(np.int64), self.starts)[nth] == 1
        return np.where((x == least) & alone, second, least)

    def answers(self, *facts: np.ndarray) -> pa.RecordBatch:
        """Facts by place in the order, sent back to the keys' blocks."""
        back = []
        for fact in facts:
            own = np.empty(len(fact), dtype=bool)
            own[self.order] = fact
            back.append(own)
        ends, out = np.cumsum(self.sizes).tolist(), []
        for x, hi in zip(self.found, ends):
            part = [f[hi - x[2] : hi] for f in back]
            if any(p.any() for p in part):
                out.append((x[0], x[1], x[2], *(pack_bits(p) for p in part), *[None] * (2 - len(part))))
        return to_batch(arrow_schema(ANSWERED), out)


def _heard(answers: list[dict] | None, n: int, of: str = "yes") -> np.ndarray:
    """A fact of a block's n keys from the buckets' answers; those without an answer have it not."""
    out = np.zeros(n, dtype=bool)
    for x in answers or ():
        out[x["base"] : x["base"] + x["n"]] = unpack_bits(x[of], x["n"])
    return out


def _later(b: Block, at: np.ndarray, groups: Groups) -> np.ndarray:
    """Whether a smaller document of the block has the same key."""
    own = b.ord[b.of(at)]
    return own > own[groups.first][groups.of]


def _again(b: Block, at: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places with repeated tuples those a period before another in the same document, and the names of both
    tuples together, in two parts."""
    repeated = np.zeros(len(b.buf) + cover.period + 1, dtype=bool)
    repeated[at] = True
    here = at[repeated[at + cover.period]]
    here = here[here + cover.period + cover.tuple <= b.ends[b.of(here)]]
    whole = cover.period + cover.tuple
    return here, b.hashes(here, whole), (b.hashes(here, whole, _OTHER) >> np.uint64(32)).astype(np.uint32)


def _around(b: Block, at: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes, less than a period, the document has before the tuple at a place and after it."""
    doc, most = b.of(at), cover.period - 1
    return np.minimum(most, at - (b.ends - b.size)[doc]), np.minimum(most, b.ends[doc] - at - cover.tuple)


def _strings(b: Block, at: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of `width` bytes over the tuples at some places: where they start, and their names in two parts."""
    before, after = _around(b, at, cover)
    side = cover.period - 1
    starts = np.unique(np.concatenate([at[(before >= off) & (after >= side - off)] - off for off in range(cover.period)]))
    return starts, b.hashes(starts, cover.width), (b.hashes(starts, cover.width, _OTHER) >> np.uint64(32)).astype(np.uint32)


def _judge_strings(found: list[tuple], cover: Cover, most: int = 250_000) -> np.ndarray:
    """By context a bit for each string of `width` bytes over its tuple that a smaller document has, too. Equal strings
    over equal tuples are brought together by their hashes; neighbours are then compared byte by byte."""
    side, width = cover.period - 1, cover.width
    span = width + side
    context = np.concatenate([np.frombuffer(unpack_bytes(x[4], x[2] * span), np.uint8).reshape(x[2], span) for x in found])
    facts = [np.frombuffer(unpack_bytes(x[5], 10 * x[2]), np.uint8) for x in found]
    ords = np.concatenate([f[: 8 * x[2]].view(np.int64) for f, x in zip(facts, found)])
    before, after = (np.concatenate([f[k * x[2] : (k + 1) * x[2]] for f, x in zip(facts, found)]) for k in (8, 9))
    up, down = _powers(span + 1)
    masks = np.zeros(len(ords), dtype=np.uint32)

    def summed(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), span + 1), dtype=np.uint64)
        np.cumsum(_BYTES[context[rows]] * up[:span], axis=1, out=out[:, 1:])
        return out

    parts = len(ords) // most + 1
    share = np.zeros(len(ords), dtype=np.int64)
    for lo in range(0, len(ords) if parts > 1 else 0, most):  # equal tuples go to the same part
        rows = np.arange(lo, min(lo + most, len(ords)))
        s = summed(rows)
        share[rows] = (mix((s[:, side + cover.tuple] - s[:, side]) * down[side]) % np.uint64(parts)).astype(np.int64)
    for part in range(parts):
        mine = np.flatnonzero(share == part)
        s = summed(mine)
        for off in range(cover.period):
            able = np.flatnonzero((before[mine] >= off) & (after[mine] >= side - off))
            lo = side - off
            key = mix((s[able, lo + width] - s[able, lo]) * down[lo])
            order = np.argsort(key)
            rows = mine[able[order]]
            new = np.ones(len(rows), dtype=bool)
            alike = np.flatnonzero(key[order][1:] == key[order][:-1])
            new[1 + alike] = (context[rows[alike + 1], lo : lo + width] != context[rows[alike], lo : lo + width]).any(axis=1)
            starts = np.flatnonzero(new)
            if len(starts) < len(rows):
                least = np.repeat(np.minimum.reduceat(ords[rows], starts), np.diff(np.append(starts, len(rows))))
                masks[rows[ords[rows] > least]] |= np.uint32(1 << off)
    return masks


def substring_dedup(docs: DataFrame, width: int = 50, hot: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256.

    A byte goes if a string of `width` bytes over it also starts in a document with a smaller id, judged on
    the input. A null text is empty; a null id is smaller than any other; rows with the same id don't remove
    each other's bytes. Repeated rows have repeated results; other columns are ignored; an empty table gives
    an empty result.

    1. Rows are written as blocks of texts. Each block sends the names of its different sampled tuples, in order, to
       the buckets that hold their ranges; a bucket merges them and tells the blocks which names other blocks have,
       too, and whether a smaller document may (ids are told apart by 256 quantiles here).
    2. Of names found again, those a period apart are named in pairs, sent and merged in the same way. A pair that a
       smaller document has covers more than `width` bytes, which go.
    3. A place whose tuple a smaller document may have, and around which some bytes aren't settled yet, asks; blocks
       with the same tuple answer. Both send the bytes around it, each different context once, to the tuple's bucket.
    4. There the strings over the tuple are compared, and those that a smaller document has, go. A tuple that stands at
       more than `hot` places, such as at the edge of a passage that a third of all documents share, sends no contexts:
       the strings over it are named, sent and merged as pairs are, once a block, so that no bucket gets them all.
    Names have so many bits that chance makes few places ask in vain; those of pairs and of strings over hot tuples have
    96 bits, so that no two different ones of a corpus of 100 TB are likely to be taken for the same; all other strings
    are compared byte by byte."""
    spark = docs.sparkSession
    scratch, cover = Scratch(spark), Cover(width)
    side, whole = cover.period - 1, cover.period + cover.tuple

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "text": pa.binary()}
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            held.sort(key=lambda x: LEAST if x[0] is None else x[0])
            return to_batch(schema, [(block, [i for i, _ in held], [len(t) for _, t in held], pack_bytes(b"".join([t for _, t in held])))])

        for doc_id, text in each_row(batches):
            text = text or b""
            if held and size + len(text) > BLOCK:
                yield out()
                block, held, size = block + 1, [], 0
            held.append((doc_id, text))
            size += len(text)
        if held:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    packed = scratch.write(rows.mapInArrow(pack, "block long, ids array<long>, sizes array<long>, text binary"), "packed")
    total = packed.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), -(-total // SHARE))
    bits = min(64, max(40, total.bit_length() + 10))
    blocks = scratch.bucketed(packed, "blocks", buckets, "block")
    scratch.drop("packed")
    scratch.release()
    cuts = np.unique(np.array(rows.approxQuantile("doc_id", [k / 256 for k in range(1, 256)], 0.001)))
    rank = lambda ords: np.searchsorted(cuts, ords.astype(np.float64), "right").astype(np.uint8)

    def named(b: Block, at: np.ndarray) -> np.ndarray:
        return b.hashes(at, cover.tuple) >> np.uint64(64 - bits)

    def sent(block: int, keys: np.ndarray, own_bits: int, facts) -> list[tuple]:
        return [(k, block, lo, hi - lo, pack_rising(keys[lo:hi]), *facts(lo, hi), 0) for k, lo, hi in _dealt(keys, own_bits, buckets)]

    def send_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, text in each_row(batches):
            b = Block(ids, sizes, text)
            at = b.places(cover)
            names = named(b, at)
            groups = Groups(names)
            ranks = rank(b.ord[b.of(at[groups.first])])
            yield to_batch(arrow_schema(SENT), sent(block, names[groups.first], bits, lambda lo, hi: (pack_lanes(ranks[lo:hi]), None)))

    def judge_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(each_row(batches)):
            bucket = Bucket(found)
            ranks = bucket.column(unpack_lanes(x[4], x[2], np.uint8) for x in found).astype(np.int16)
            yield bucket.answers(np.repeat(bucket.counts > 1, bucket.counts), bucket.least_of_others(ranks) <= ranks)

    def to_buckets(frame: DataFrame) -> DataFrame:
        dealt = frame.select("bucket", "block", "base", "n", "keys", "facts", "more")
        return deal(dealt, buckets).select("block", "base", "n", "keys", "facts", "more")

    def answered(answers: DataFrame, own: DataFrame | None = None) -> DataFrame:
        """The blocks with the answers that they got and what they kept of the step before."""
        told = answers.groupBy("block").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "block"))).alias("answers"))
        out = blocks.join(told.hint("merge"), "block", "left")
        if own is not None:
            out = out.join(own.select("block", F.col("n").alias("own_n"), F.col("keys").alias("own_keys"), F.col("facts").alias("own_facts"), F.col("more").alias("own_more")).hint("merge"), "block", "left")
        return out.select("block", "ids", "sizes", "text", "answers", *(("own_n", "own_keys", "own_facts", "own_more") if own is not None else ()))

    def step(frame: DataFrame, send, name: str) -> tuple[DataFrame, DataFrame]:
        """Writes what blocks send and what they keep."""
        made = scratch.write(frame.mapInArrow(send, SENT), name, "kind")
        scratch.release()
        return made.filter("kind = 0"), made.filter("kind = 1")

    # 1. names of sampled tuples
    answers = scratch.write(to_buckets(blocks.select("block", "ids", "sizes", "text").mapInArrow(send_tuples, SENT)).mapInArrow(judge_tuples, ANSWERED), "tuples")
    scratch.release()

    # 2. names of pairs
    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, text, answers in each_row(batches):
            b = Block(ids, sizes, text)
            at = b.places(cover)
            groups = Groups(named(b, at))
            own = b.ord[b.of(at)]
            again = (_heard(answers, len(groups.first)) | (own[groups.last] > own[groups.first]))[groups.of]
            smaller = _later(b, at, groups) | _heard(answers, len(groups.first), "also")[groups.of]
            at, smaller = at[again], smaller[again]
            out = [(-1, block, 0, len(at), pack_rising(at), pack_bits(smaller), None, 1)]
            here, name, check = _again(b, at, cover)
            groups = Groups(name, check)
            name, check, ranks = name[groups.first], check[groups.first], rank(b.ord[b.of(here[groups.first])])
            yield to_batch(arrow_schema(SENT), out + sent(block, name, 64, lambda lo, hi: (pack_lanes(ranks[lo:hi]), pack_bytes(check[lo:hi].tobytes()))))

    def judge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(each_row(batches)):
            bucket = Bucket(found, [np.frombuffer(unpack_bytes(x[5], 4 * x[2]), np.uint32) for x in found])
            ranks = bucket.column(unpack_lanes(x[4], x[2], np.uint8) for x in found).astype(np.int16)
            yield bucket.answers(bucket.least_of_others(ranks) < ranks)

    pairs, repeated = step(answered(answers), send_pairs, "pairs")
    scratch.drop("tuples")
    answers = scratch.write(to_buckets(pairs).mapInArrow(judge_pairs, ANSWERED), "pair-answers")
    scratch.release()

    # 3. places that ask, and contexts
    def send_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, text, answers, n, at, smaller, _ in each_row(batches):
            b, at, smaller = Block(ids, sizes, text), unpack_rising(at, n).astype(np.int64), unpack_bits(smaller, n)
            here, name, check = _again(b, at, cover)
            groups = Groups(name, check)
            gone = here[_later(b, here, groups) | _heard(answers, len(groups.first))[groups.of]]
            edge = np.zeros(len(b.buf) + 1, dtype=np.int32)
            np.add.at(edge, gone, 1)
            np.subtract.at(edge, gone + whole, 1)
            open_bytes = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) == 0)])
            before, after = _around(b, at, cover)
            first, end = at - before, at + cover.tuple + after
            asks = smaller & (end - first >= width) & (open_bytes[end] > open_bytes[first])
            out = [(-1, block, 0, n, pack_rising(gone), pack_bits(asks), len(gone).to_bytes(8, "little") + pack_rising(at), 1)]
            names = named(b, at)
            groups = Groups(names)
            asked = np.zeros(len(groups.first), dtype=bool)
            asked[groups.of[asks]] = True
            many = np.bincount(groups.of, minlength=len(asked)).astype(np.uint32)
            yield to_batch(arrow_schema(SENT), out + sent(block, names[groups.first], bits, lambda lo, hi: (pack_bits(asked[lo:hi]), pack_lanes(many[lo:hi]))))

    def judge_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(each_row(batches)):
            bucket = Bucket(found)
            asked = np.logical_or.reduceat(bucket.column(unpack_bits(x[4], x[2]) for x in found), bucket.starts)
            many = np.add.reduceat(bucket.column(unpack_lanes(x[5], x[2], np.uint32) for x in found).astype(np.int64), bucket.starts)
            yield bucket.answers(*(np.repeat(x, bucket.counts) for x in (asked, asked & (many > hot))))

    asks, kept = step(answered(answers, repeated), send_asks, "asks")
    scratch.drop("pairs", "pair-answers")
    answers = scratch.write(to_buckets(asks).mapInArrow(judge_asks, ANSWERED), "ask-answers")
    scratch.release()

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, text, answers, n, gone, asks, at in each_row(batches):
            b, asks = Block(ids, sizes, text), unpack_bits(asks, n)
            n_gone, at = at[:8], unpack_rising(at[8:], n).astype(np.int64)
            groups = Groups(named(b, at))
            told, common = (_heard(answers, len(groups.first), of)[groups.of] for of in ("yes", "also"))
            often = at[common]
            at, asks = at[told & ~common], asks[told & ~common]
            before, after = _around(b, at, cover)
            key = mix(b.hashes(at - before, before + cover.tuple + after) ^ mix((before * cover.period + after).astype(np.uint64)))
            groups = Groups(key)
            later = _later(b, at, groups)
            first = groups.first
            name = named(b, at)[first]
            order = np.argsort(name)  # contexts by their tuple's bucket
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            name, first = name[order], first[order]
            spot = at[first][:, None] + np.arange(-side, width)
            inside = (spot >= (at - before)[first][:, None]) & (spot < (at + cover.tuple + after)[first][:, None])
            context = np.where(inside, b.buf[np.clip(spot, 0, max(0, len(b.buf) - 1))], 0).astype(np.uint8) if len(first) else np.zeros((0, span), np.uint8)
            ords = b.ord[b.of(at[first])]
            around = [x[first].astype(np.uint8) for x in (before, after)]
            mine = np.concatenate([_u32(place[groups.of[asks]]), _u32(later[asks])])
            out = [(-1, block, int.from_bytes(n_gone, "little"), int(asks.sum()), gone, pack_rising(at[asks]), pack_bytes(mine.tobytes()), 1)]
            for k, lo, hi in _dealt(name, bits, buckets):
                facts = ords[lo:hi].tobytes() + b"".join(x[lo:hi].tobytes() for x in around)
                out.append((k, block, lo, hi - lo, None, pack_bytes(context[lo:hi].tobytes()), pack_bytes(facts), 0))
            if len(often):
                starts, name, check = _strings(b, often, cover)
                groups = Groups(name, check)
                name, check, own = name[groups.first], check[groups.first], b.ord[b.of(starts[groups.first])]
                out.append((-1, block, 0, len(often), pack_rising(often), None, None, 3))
                out += [(*row[:-1], 2) for row in sent(block, name, 64, lambda lo, hi: (pack_lanes(own[lo:hi]), pack_bytes(check[lo:hi].tobytes())))]
            yield to_batch(arrow_schema(SENT), out)

    span = width + side
    _u32 = lambda x: x.astype(np.uint32)

    def judge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(each_row(batches)):
            masks, at, out = _judge_strings(found, cover), 0, []
            for block, base, n, *_ in found:
                own = masks[at : at + n]
                at += n
                if own.any():
                    out.append((block, base, n, pack_lanes(own), None))
            yield to_batch(arrow_schema(ANSWERED), out)

    def judge_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(each_row(batches)):
            bucket = Bucket(found, [np.frombuffer(unpack_bytes(x[5], 4 * x[2]), np.uint32) for x in found])
            ords = bucket.column(unpack_lanes(x[4], x[2], np.int64) for x in found)
            yield bucket.answers(bucket.least_of_others(ords) < ords)

    made = scratch.write(answered(answers, kept).mapInArrow(send_contexts, SENT), "contexts", "kind")
    scratch.drop("asks", "ask-answers")
    scratch.release()
    answers = scratch.write(to_buckets(made.filter("kind = 0")).mapInArrow(judge_contexts, ANSWERED), "context-answers")
    common = scratch.write(to_buckets(made.filter("kind = 2")).mapInArrow(judge_common, ANSWERED), "common-answers")
    scratch.release()

    # 4. all that goes
    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
        for ids, sizes, text, answers, n_gone, n, gone, at, mine, n_often, often, said in each_row(batches):
            b, gone, at = Block(ids, sizes, text), unpack_rising(gone, n_gone).astype(np.int64), unpack_rising(at, n).astype(np.int64)
            place, later = np.frombuffer(unpack_bytes(mine, 8 * n), np.uint32).reshape(2, n)
            masks = np.zeros(int(place.max()) + 1 if n else 1, dtype=np.uint32)
            for x in answers or ():
                own = unpack_lanes(x["yes"], x["n"], np.uint32)[: max(0, len(masks) - x["base"])]
                masks[x["base"] : x["base"] + len(own)] = own
            edge = np.zeros(len(b.buf) + 1, dtype=np.int32)

            def cut(first: np.ndarray, length: int) -> None:
                np.add.at(edge, first, 1)
                np.subtract.at(edge, first + length, 1)

            cut(gone, whole)
            if n_often:
                starts, name, check = _strings(b, unpack_rising(often, n_often).astype(np.int64), cover)
                groups = Groups(name, check)
                cut(starts[_later(b, starts, groups) | _heard(said, len(groups.first))[groups.of]], width)
            before, after = _around(b, at, cover)
            of = masks[place] if n else np.zeros(0, np.uint32)
            for off in range(cover.period):
                able = (before >= off) & (after >= side - off)
                cut(at[able & ((later == 1) | ((of >> np.uint32(off)) & np.uint32(1) == 1))] - off, width)
            off, out, at = np.cumsum(edge[:-1]) > 0, [], 0
            for doc_id, size in zip(ids, sizes):
                own_off = off[at : at + size]
                kept = b.buf[at : at + size][~own_off].tobytes()
                spans = int(np.count_nonzero(own_off[1:] & ~own_off[:-1])) + bool(size and own_off[0])
                out.append((doc_id, size, int(own_off.sum()), spans, kept, hashlib.sha256(kept).hexdigest()))
                at += size
            yield to_batch(schema, out)

    def told(heard: DataFrame, name: str) -> DataFrame:
        return heard.groupBy("block").agg(F.collect_list(F.struct("base", "n", "yes")).alias(name)).hint("merge")

    kept = made.filter("kind = 1").select("block", F.col("base").alias("n_gone"), "n", "keys", "facts", "more").hint("merge")
    often = made.filter("kind = 3").select("block", F.col("n").alias("n_often"), F.col("keys").alias("often")).hint("merge")
    final = blocks.join(told(answers, "answers"), "block", "left").join(kept, "block", "left").join(often, "block", "left").join(told(common, "said"), "block", "left")
    final = final.select("ids", "sizes", "text", "answers", "n_gone", "n", "keys", "facts", "more", "n_often", "often", "said")
    return final.mapInArrow(cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
