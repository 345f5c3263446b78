"""LM scoring with Brown classes: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import _STEP, mix
from .packed import arrow_schema, deal, each_row, pack_lanes, pack_rising, to_batch, unpack_lanes, unpack_rising
from .shared import Scratch, shuffle_partitions

#: Stands for the end of a document among tokens, which hold no space.
END = b" "


@dataclass
class ClassModel:
    """The bounded part of the model, which is broadcast: the `words` most frequent words."""

    index: dict[bytes, int] = field(default_factory=dict)  # by falling count; the end token too
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each indexed word, one more for all others
    tokens: int = 0  # N
    types: int = 0  # V
    rest_tokens: int = 0
    rest_types: int = 0
    log_move: np.ndarray = field(default_factory=lambda: np.zeros((1, 1)))
    log_emit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    open_whole: float = 1.0

    def base(self, count: np.ndarray | int):
        return np.log10((np.asarray(count) + 1) / (self.tokens + self.types + 1))


def tokens_of(batch: pa.RecordBatch, at: int, step: int = 64) -> tuple[list[bytes], list[int]]:
    """Tokens of some documents, each with an end token, and the number of tokens of each."""
    found: list[bytes] = []
    sizes = []
    for text in batch.column("text").slice(at, step):
        words = (text.as_py() or b"").lower().split()
        found += words
        found.append(END)
        sizes.append(len(words) + 1)
    return found, sizes


def _ids(tokens: list[bytes], index: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(index.get, tokens, repeat(other)), dtype=np.int64, count=len(tokens))


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """Classes of all words but the last two of a word bigram matrix, which stay in classes of their own
    (all other words, the end token). Words move one by one, frequent ones first, to the class that most
    raises sum N(c,d) log N(c,d) - sum N(c) log N(c) over left and right counts, until none moves."""
    n = len(pairs) - 2
    total = classes + 2
    own = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    eye = np.eye(total)[own]
    left, right = pairs.T @ eye, pairs @ eye  # of each word, by class of the word before, after
    between = eye.T @ pairs @ eye
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)
    moved = True
    while moved:
        moved = False
        for w in range(n):
            old, self_pairs = own[w], pairs[w, w]
            lw, rw = left[w].copy(), right[w].copy()
            lw[old] -= self_pairs
            rw[old] -= self_pairs
            between[old] -= rw
            between[:, old] -= lw
            between[old, old] -= self_pairs
            out_sum, in_sum = between.sum(axis=1) + lw, between.sum(axis=0) + rw  # the word's pairs count whichever class it joins
            gain = (f(between + rw) - f(between)).sum(axis=1) + (f(between.T + lw) - f(between.T)).sum(axis=1)
            d = np.diagonal(between)
            gain += f(d + lw + rw + self_pairs) - f(d + rw) - f(d + lw) + f(d)
            gain -= f(out_sum + rw.sum() + self_pairs) - f(out_sum) + f(in_sum + lw.sum() + self_pairs) - f(in_sum)
            new = int(gain[:classes].argmax())
            if gain[new] <= gain[old] + 1e-6:
                new = old
            between[new] += rw
            between[:, new] += lw
            between[new, new] += self_pairs
            if new != old:
                moved = True
                own[w] = new
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
    return own


def objective(between: np.ndarray) -> float:
    """What exchange clustering raises: the log likelihood of the classes' bigrams, but for a constant."""
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return f(between) - f(between.sum(axis=0)) - f(between.sum(axis=1))


def proposals(left: np.ndarray, right: np.ndarray, own: np.ndarray, between: np.ndarray, closed: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of the first `closed` classes for each word, and by how much it raises the objective (to first order,
    the word's own bigrams taken off its present class). left, right: the word's bigrams by class of the word before,
    after. own: present classes."""
    half, total = 0.5, len(between)
    rows, columns = between.sum(axis=1) + half * total, between.sum(axis=0) + half * total
    lift = np.log(between + half) - np.log(rows)[:, None] - np.log(columns)
    score = (left @ lift + right @ lift.T)[:, :closed]
    off = lambda x, y: np.log(np.maximum(x - y, 0) + half)
    n_left, n_right = left.sum(axis=1, keepdims=True), right.sum(axis=1, keepdims=True)
    now = (left * (off(between[:, own].T, left) - np.log(rows) - off(columns[own][:, None], n_left))).sum(axis=1)
    now += (right * (off(between[own], right) - np.log(columns) - off(rows[own][:, None], n_right))).sum(axis=1)
    placed = np.flatnonzero(own < closed)
    score[placed, own[placed]] = now[placed]
    best = score.argmax(axis=1)
    gain = score[np.arange(len(own)), best] - now
    gain[own >= closed] = np.inf
    gain[best == own] = 0
    return best, gain


PAIRS = "bucket int, m0 int, codes0 binary, n0 binary, m1 int, codes1 binary, n1 binary"
SUMS = "bucket int, between binary, classes binary"


class Pairs:
    """All bigrams of the corpus over the index, counted: those of a word w are in bucket w mod `buckets`, once by the
    word before and once by the word after, as codes (w div buckets) * size + other word."""

    def __init__(self, texts: DataFrame, scratch: Scratch, model: ClassModel, buckets: int):
        self.scratch, self.buckets, self.size = scratch, buckets, len(model.index) + 1
        size, end, spark = self.size, model.index[END], texts.sparkSession
        per = -(-size // buckets)
        index = spark.sparkContext.broadcast(model.index)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, held, n = index.value, [], 0

            def out() -> pa.RecordBatch:
                codes, sums = _summed([c for c, _ in held], [s for _, s in held])
                before, after, made = codes // size, codes % size, []
                for side, (w, other) in enumerate(((before, after), (after, before))):
                    code = (w % buckets * per + w // buckets) * size + other
                    order = np.argsort(code)
                    code, own = code[order], sums[order]
                    cuts = np.searchsorted(code, np.arange(buckets + 1) * per * size)
                    for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                        lo, hi = int(cuts[k]), int(cuts[k + 1])
                        part = (hi - lo, pack_rising(code[lo:hi] - k * per * size), pack_lanes(own[lo:hi].astype(np.uint32)))
                        made.append((k, *((*part, 0, None, None) if side == 0 else (0, None, None, *part))))
                return to_batch(arrow_schema(PAIRS), made)

            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    ids = _ids(tokens_of(batch, at)[0], words, size - 1)
                    held.append(np.unique(np.concatenate([[end], ids[:-1]]) * size + ids, return_counts=True))
                    n += len(held[-1][0])
                    if n > 2_000_000:
                        held = [_summed([c for c, _ in held], [s for _, s in held])]
                        n = len(held[0][0])
                        if n > 4_000_000:
                            yield out()
                            held, n = [], 0
            if held:
                yield out()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list[tuple]] = {}
            for row in each_row(batches):
                found.setdefault(row[0], []).append(row[1:])
            for bucket, rows in found.items():
                made: list = [bucket]
                for at in (0, 3):
                    some = [r[at : at + 3] for r in rows if r[at]]
                    codes, sums = _summed([unpack_rising(c, m).astype(np.int64) for m, c, _ in some], [unpack_lanes(x, m, np.uint32).astype(np.int64) for m, _, x in some])
                    made += [len(codes), pack_rising(codes), pack_lanes(sums.astype(np.uint64))]
                yield to_batch(arrow_schema(PAIRS), [tuple(made)])

        dealt = deal(texts.mapInArrow(count, PAIRS), buckets)
        self.table = scratch.write(dealt.mapInArrow(merge, PAIRS), "pairs")
        scratch.release()

    def summed(self, classes: np.ndarray, total: int, between: np.ndarray | None = None, closed: int = 0, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The bigrams by class, and each word's next class: that of the exchange that most raises the objective, given
        the classes' bigrams of the round before. In each round half of the words may move, so that words do not
        change places for ever; words in no closed class yet all do."""
        size, buckets = self.size, self.buckets
        shared = self.table.sparkSession.sparkContext.broadcast((classes.astype(np.int32), between))

        def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, held = shared.value
            for bucket, m0, codes0, n0, m1, codes1, n1 in each_row(batches):
                words = np.arange(bucket, size, buckets)
                own = of[words]

                def near(m: int, codes: bytes, n: bytes) -> np.ndarray:
                    codes = unpack_rising(codes, m).astype(np.int64)
                    at = codes // size * total + of[codes % size]
                    return np.bincount(at, weights=unpack_lanes(n, m, np.uint64), minlength=len(words) * total).reshape(len(words), total)

                right = near(m0, codes0, n0)
                sums = np.zeros((total, total))
                np.add.at(sums, own, right)
                new = own
                if held is not None:
                    best, gain = proposals(near(m1, codes1, n1), right, own, held, closed)
                    turns = (mix((words.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64(turn)) & np.uint64(1)) == 1
                    moves = (gain > 1e-6) & (turns | (own >= closed)) & (own <= closed) & (words < size - 1)
                    new = np.where(moves, best, own)
                yield to_batch(arrow_schema(SUMS), [(bucket, pack_lanes(sums.ravel()), new.astype(np.int32).tobytes())])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, made = np.zeros(total * total), []
            for bucket, part, new in each_row(batches):
                sums += unpack_lanes(part, total * total, np.float64)
                made.append((bucket, None, new))
            if made:
                yield to_batch(arrow_schema(SUMS), [(made[0][0], sums.tobytes(), made[0][2]), *made[1:]])

        parts = self.table.mapInArrow(propose, SUMS).repartition(max(1, math.isqrt(buckets)))
        sums, new = np.zeros((total, total)), classes.copy()
        for r in parts.mapInArrow(add, SUMS).collect():  # total * total numbers from each of few tasks, and a class a word
            if r.between is not None:
                sums += np.frombuffer(r.between).reshape(total, total)
            new[r.bucket :: buckets] = np.frombuffer(r.classes, np.int32)
        shared.destroy()
        return sums, new


def _summed(codes: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of codes and their counts as one, codes in order."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, n = np.concatenate(codes), np.concatenate(sums)
    order = np.argsort(code, kind="stable")  # merges sorted lists
    code = code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[starts], np.add.reduceat(n[order], starts) if len(code) else n


def cluster(pairs: Pairs, model: ClassModel, classes: int, start: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word of the index and of all others, bigrams by class). All words of the index are exchanged.

    The `start` most frequent words are exchanged one by one on the driver. From there on rounds go over the whole index
    in the cluster: each task proposes moves for its words, and the classes' bigrams are merged. It ends when a
    round raises the log likelihood by less than `tolerance` a token; the likeliest classes count."""
    size, end, total = pairs.size, model.index[END], classes + 2
    first = np.array([k for k in range(size - 1) if k != end][:start], dtype=np.int64)
    seed = np.full(size, len(first), dtype=np.int64)
    seed[first] = np.arange(len(first))
    seed[end] = len(first) + 1
    counted, _ = pairs.summed(seed, len(first) + 2)
    own = exchange(counted, classes)
    of = own[seed]  # words not seeded stand in the open class, as all others do
    eye = np.eye(total)[own]
    between, best, found, turn = eye.T @ counted @ eye, -math.inf, (of, None), 0
    while True:
        sums, new = pairs.summed(of, total, between, classes, turn)
        raised = objective(sums) - best
        if turn and raised < tolerance * max(1, model.tokens):
            return found if raised <= 0 else (of, sums)
        if turn:
            best = objective(sums)
        found, of, between, turn = (of, sums), new, sums, turn + 1


def train(texts: DataFrame, scratch: Scratch, words: int = 250_000, classes: int | None = None, start: int = 300, smooth: float = 5.0, tolerance: float = 1e-4) -> tuple[ClassModel, DataFrame]:
    """The model and the table (word, n) of all counts. Counts and bigrams are of the whole corpus.

    The `words` most frequent words make up the index, which is broadcast; all of them are clustered, into as many
    classes as the cube root of the number of different words, if `classes` doesn't say otherwise. Other words
    share one open class."""
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                seen.update(tokens_of(batch, at)[0])
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        yield out()

    counted = scratch.write(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    scratch.release()
    by_size = counted.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()
    model, taken, least = ClassModel(), 0, math.inf
    model.tokens, model.types = sum(r.tokens for r in by_size), sum(r.types for r in by_size)
    for r in sorted(by_size, key=lambda r: -r.size):
        if taken + r.types > words:
            break
        taken, least = taken + r.types, r.least
    top = counted.filter(F.col("n") >= int(least)).toArrow() if taken else counted.limit(0).toArrow()
    listed = sorted(zip((-n for n in top.column("n").to_pylist()), top.column("word").to_pylist()))
    if not any(w == END for _, w in listed):
        listed.append((-(r[0] if (r := counted.filter(F.col("word") == F.lit(bytearray(END))).select("n").first()) else 0), END))
    model.index = {w: k for k, (_, w) in enumerate(listed)}
    model.counts = np.array([-n for n, _ in listed], dtype=np.int64)
    model.rest_tokens, model.rest_types = model.tokens - int(model.counts.sum()), model.types - sum(1 for n, _ in listed if n)

    classes = classes or max(2, round(model.types ** (1 / 3)))
    total, size = classes + 2, len(listed)
    pairs = Pairs(texts, scratch, model, shuffle_partitions(spark))
    of, moves = cluster(pairs, model, classes, start, tolerance)
    model.classes = of.astype(np.int32)  # the last one stands for words outside the index
    kinds = of[:size]
    of_class = np.bincount(kinds, weights=model.counts, minlength=total)
    able = np.bincount(kinds, minlength=total) > 0
    able[classes] = True  # the open class has room for words never seen
    share = (moves.sum(axis=0) + 1) * able
    share /= share.sum()
    model.log_move = np.log10((moves + smooth * share) / (moves.sum(axis=1, keepdims=True) + smooth), out=np.full((total, total), -np.inf), where=np.broadcast_to(able, (total, total)))
    whole = model.rest_tokens + model.rest_types + 1
    model.log_emit = np.log10(np.maximum(model.counts, 1) / np.maximum(of_class[kinds], 1))
    model.open_whole = whole
    return model, counted


def class_lm_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Documents with crc32(id as text) mod `modulus` = held_out are scored but not learned from. A null text
    is empty (its end token only); a null id counts as the empty text for that remainder. Repeated rows are
    learned and scored each. An empty table gives an empty result; other columns are ignored.

    One pass scores all tokens but those of words outside the broadcast index; these words meet their
    counts in a shuffled join and add their share per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == held_out
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    model, counted = train(texts.filter("not held_out").select("text"), scratch, **sizes)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size, kinds = len(model.index), model.classes
        base, emit = np.append(model.base(model.counts), 0.0), np.append(model.log_emit, 0.0)
        known, end = np.append(model.counts > 0, False), kinds[model.index[END]]
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for at in range(0, batch.num_rows, 64):
                tokens, sizes = tokens_of(batch, at)
                ids = _ids(tokens, model.index, size)
                k = kinds[ids]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                before = np.concatenate([[end], k[:-1]])
                sums = [np.add.reduceat(x, starts) for x in (known[ids].astype(np.int64), base[ids], model.log_move[before, k] + emit[ids])]
                rare = np.flatnonzero(ids == size)
                cut = np.searchsorted(rare, np.append(starts, len(ids)))
                found = [Counter(tokens[i] for i in rare[a:b].tolist()) for a, b in zip(cut, cut[1:])]
                for c, x in zip(columns, (sizes, *(s.tolist() for s in sums), [list(f) for f in found], [list(f.values()) for f in found])):
                    c += x
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))))], names=["doc_id", "held_out", "n_tokens", "known", "base", "lm", "words", "times"])

    part = texts.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, known long, base double, lm double, words array<binary>, times array<int>").withColumn("rid", F.monotonically_increasing_id())
    part = scratch.write(part, "part")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = (
        part.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("m"))
        .join(counted.hint("merge"), "word", "left")
        .groupBy("rid")
        .agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * F.log10((c + 1) / F.lit(float(model.tokens + model.types + 1)))).alias("base2"), F.sum(F.col("m") * F.log10((c + 1) / F.lit(float(model.open_whole)))).alias("lm2"))
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return part.drop("words", "times").join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("known2")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("base2")).alias("base_score"), (F.col("lm") + zero("lm2")).alias("score")
    )
