"""Near-duplicate detection: ProbMinHash signatures of weighted shingles, banding, verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, join_facts, row_key

#: The multipliers and the increment of the splitmix64 generator.
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: An odd base of byte-wise rolling hashes and its inverse modulo 2**64.
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(1 << max(20, n.bit_length()), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, digits and non-ASCII characters, in lower case) and the place
    of each text's first word among them, with the end."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
    up, down = _powers(len(buf) + 1)
    word = _IS_WORD[buf]
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up[: len(buf)])])
    hashes = mix((summed[ends] - summed[starts]) * down[starts])
    firsts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return hashes, np.searchsorted(starts, firsts)


def weighted_shingles(hashes: np.ndarray, cuts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted. A text of 1 to width - 1 words is one shingle; one without words has none."""
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    n = len(hashes) - width + 1
    if n > 0:
        found = np.zeros(n, np.uint64)
        for k in range(width):
            found = mix(found * _MIX2 + hashes[k : k + n] + _STEP)
        inside = doc[:n] == doc[width - 1 :]
        docs, found = doc[:n][inside], found[inside]
    else:
        docs, found = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < width))
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(hashes[cuts[i] : cuts[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short]
        docs, found = np.concatenate([docs, short]), np.concatenate([found, np.array(whole, np.uint64)])
    order = np.lexsort((found, docs))
    docs, found = docs[order], found[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (found[1:] != found[:-1])])) if len(docs) else np.zeros(0, np.int64)
    return docs[new], found[new], np.diff(np.append(new, len(docs)))


def prob_minhash(docs: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, n_docs x m. Each shingle is a Poisson process with its weight as rate; each
    arrival falls into a random register, which keeps the shingle that came first. A shingle stops as soon
    as its next arrival is later than every register's. Two signatures agree in a register with the
    probability Jaccard of their texts."""
    first, sig = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    at, state, rate, ids = docs * m, shingles, weights.astype(float), shingles
    time = np.zeros(len(docs))
    while len(at):
        state = state + _STEP
        random = mix(state)
        time = time - np.log(((random >> np.uint64(12)).astype(float) + 0.5) / 2.0**52) / rate
        slot = at + (mix(random ^ _MIX1) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        sig[slot[won]] = ids[won]
        on = time < first.reshape(n_docs, m).max(axis=1)[at // m]
        at, state, rate, ids, time = at[on], state[on], rate[on], ids[on], time[on]
    return sig.reshape(n_docs, m)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i), exactly."""
    ids, at = np.unique(np.concatenate([x[0], y[0]]), return_inverse=True)
    if not len(ids):
        return 0.0
    a, b = np.zeros(len(ids)), np.zeros(len(ids))
    a[at[: len(x[0])]], b[at[len(x[0]) :]] = x[1], y[1]
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    upto, after = np.cumsum(a), b.sum() - np.cumsum(b)
    both = (a > 0) & (b > 0)
    return float((1.0 / (upto[both] / a[both] + after[both] / b[both])).sum())


def _chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and (size + len(t) > most or k - at >= 512):
            yield at, k
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def signatures(rows: DataFrame, bands: int, per_band: int, width: int) -> DataFrame:
    """rows (doc_id, r1, r2, text) as (doc_id, r1, r2, key, bands): key is the same for texts with the same
    words; bands is empty for texts without words, whose key is that of the text itself."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = mix(np.arange(1, bands * per_band + 1, dtype=np.uint64) * _STEP).reshape(bands, per_band)
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            keys, found = [], []
            for lo, hi in _chunks(texts):
                part = texts[lo:hi]
                hashes, cuts = word_hashes(part)
                sig = prob_minhash(*weighted_shingles(hashes, cuts, width), len(part), bands * per_band)
                banded = mix((mix(sig.reshape(len(part), bands, per_band) ^ lanes) * lanes).sum(axis=2)).view(np.int64)
                for i, t in enumerate(part):
                    own = hashes[cuts[i] : cuts[i + 1]]
                    keys.append(hashlib.blake2b(own.tobytes() if len(own) else b"\0" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    found.append(banded[i] if len(own) else banded[i, :0])
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), lists], names=["doc_id", "r1", "r2", "key", "bands"])

    return rows.mapInArrow(sign, "doc_id long, r1 long, r2 long, key binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts' probability Jaccard is at least the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = {k: t for ks, ts in ((a, batch.column(2)), (b, batch.column(3))) for k, t in zip(ks, ts) if k not in known}
            if len(known) > 2000:
                known.clear()
                new = {k: t for ks, ts in ((a, batch.column(2)), (b, batch.column(3))) for k, t in zip(ks, ts)}
            nodes, contents = list(new), [t.as_py() or "" for t in new.values()]
            for lo, hi in _chunks(contents):
                docs, shingles, weights = weighted_shingles(*word_hashes(contents[lo:hi]), width)
                cut = np.searchsorted(docs, np.arange(hi - lo + 1))
                for i, node in enumerate(nodes[lo:hi]):
                    known[node] = shingles[cut[i] : cut[i + 1]], weights[cut[i] : cut[i + 1]]
            good = [probability_jaccard(known[x], known[y]) >= threshold - 1e-12 for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _shingle_lists(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """weighted_shingles of any number of texts."""
    parts = []
    for lo, hi in _chunks(texts):
        docs, shingles, weights = weighted_shingles(*word_hashes(texts[lo:hi]), width)
        parts.append((docs + lo, shingles, weights))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def block_links(queries: list[str], members: list[str], threshold: float, width: int) -> Iterator[tuple[int, int]]:
    """All (query, member) with a probability Jaccard of at least the threshold. Common shingles are counted
    for all pairs at once; texts whose shingles all count once have their set Jaccard, and of the others
    those are compared whose common shingles make up enough of either text."""
    n, m = len(queries), len(members)
    docs, shingles, weights = _shingle_lists([*queries, *members], width)
    ids, at = np.unique(shingles, return_inverse=True)
    is_query = docs < n
    on_both = np.zeros(len(ids), dtype=np.int8)
    on_both[at[is_query]] |= 1
    on_both[at[~is_query]] |= 2
    place = np.cumsum(on_both == 3) - 1
    size = np.bincount(docs, minlength=n + m).astype(np.float64)
    mass = np.bincount(docs, weights=weights, minlength=n + m)
    common, left, right = (np.zeros((n, m), dtype=np.float32) for _ in range(3))
    shared = on_both[at] == 3
    docs_s, at_s, weights_s = docs[shared], place[at[shared]], weights[shared]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        one, heavy = (np.zeros((n + m, 4096), dtype=np.float32) for _ in range(2))
        here = (at_s >= lo) & (at_s < lo + 4096)
        one[docs_s[here], at_s[here] - lo] = 1
        heavy[docs_s[here], at_s[here] - lo] = weights_s[here]
        common += one[:n] @ one[n:].T
        left += heavy[:n] @ one[n:].T
        right += one[:n] @ heavy[n:].T
    simple = mass == size
    jaccard = common / np.maximum(size[:n, None] + size[None, n:] - common, 1)
    both_simple = simple[:n, None] & simple[None, n:]
    for i, j in np.argwhere(both_simple & (jaccard >= threshold - 1e-6)).tolist():
        yield i, j
    able = ~both_simple & (left >= (threshold - 1e-6) * mass[:n, None]) & (right >= (threshold - 1e-6) * mass[None, n:])
    cut = np.searchsorted(docs, np.arange(n + m + 1))
    part = lambda k: (shingles[cut[k] : cut[k + 1]], weights[cut[k] : cut[k + 1]])
    for i, j in np.argwhere(able).tolist():
        if probability_jaccard(part(i), part(n + j)) >= threshold - 1e-12:
            yield i, j


def rest_links(rows: DataFrame, texts: DataFrame, scratch: Scratch, threshold: float, width: int, block: int) -> DataFrame:
    """Links (a, b) between components that leaders left apart, from rows (band, node, label).

    The query set are the nodes outside their band's largest component; each meets all of the band's nodes,
    in blocks of about `block` nodes, and yields one link for each component that it reaches. No pair becomes
    a row unless it is such a link."""
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("queries"))
    facts = scratch.write(facts, "rest-facts")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = join_facts(rows, facts, ["band"], "n", total)
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), parts(c)).cast("int")
    asked = known.filter("label <> main").select("band", "node", "label", F.lit(True).alias("asks"), own("queries", 1).alias("i"), F.explode(F.sequence(F.lit(0), parts("n") - 1)).alias("j"))
    met = known.select("band", "node", "label", F.lit(False).alias("asks"), own("n", 2).alias("j"), F.explode(F.sequence(F.lit(0), parts("queries") - 1)).alias("i"))
    dealt = asked.unionByName(met).join(texts.hint("merge"), "node")

    def meet(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), dtype=bool)
        nodes, labels, contents = table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("text").to_pylist()
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        seen = {}
        for i, j in block_links([contents[k] for k in q], [contents[k] for k in m], threshold, width):
            if labels[q[i]] != labels[m[j]]:
                seen.setdefault((int(nodes[q[i]]), int(labels[m[j]])), int(nodes[m[j]]))
        return pa.table({"a": pa.array([a for a, _ in seen], pa.int64()), "b": pa.array(list(seen.values()), pa.int64())})

    return dealt.select("band", "i", "j", "asks", "node", "label", "text").groupBy("band", "i", "j").applyInArrow(meet, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) of every node in a link: the smallest node that can be reached. Labels spread over links
    and jump over each other's labels until none changes; each round is a written table."""
    both = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        heard = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = labels.join(heard.hint("merge"), "node").join(jump.hint("merge"), "label")
        new = scratch.write(step.select("node", F.least("label", "heard", "jump").alias("label"), (F.least("label", "heard", "jump") < F.col("label")).alias("moved")), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label")
        if not new.filter("moved").take(1):
            return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 24, per_band: int = 5, leader_rounds: int = 1, block: int = 512, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, class_id (the smallest id of its class), class_size, kept (one row of each class),
    and r1, r2 (its row key). A class joins texts linked by a probability Jaccard of word shingles of at
    least `threshold`, and texts with the same words.

    Null texts count as empty; texts without words match only equal texts. Texts of fewer than `width` words
    are one shingle. Null ids are smaller than others. Equal rows are in one class, one of them kept. An
    empty table gives an empty result; other columns are ignored.

    Texts with the same words become one node first. Nodes sharing a band are compared with the band's
    leader, in some rounds; bands whose nodes are in one component by then are done. In the others the nodes
    outside the largest component are compared with all, in blocks, so that no candidate is dropped. With 24 bands of 5
    registers a pair at 0.8 is missed with probability 0.00007."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    r1, r2 = row_key(F.col(id_col), text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), text.alias("text"))
    signed = scratch.write(signatures(rows, bands, per_band, width).withColumn("rid", F.monotonically_increasing_id()), "signed")
    nodes = scratch.write(signed.groupBy("key").agg(F.min(F.struct("doc_id", "rid", "r1", "r2", "bands")).alias("x"), F.count("*").alias("copies")).select("key", "copies", F.col("x.rid").alias("node"), "x.doc_id", "x.r1", "x.r2", "x.bands"), "nodes")
    banded = scratch.write(nodes.select("node", F.posexplode("bands").alias("i", "band")).select(F.xxhash64("i", "band").alias("band"), "node"), "banded")
    shared = scratch.write(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).filter("n > 1"), "shared")
    open_rows = scratch.write(banded.join(shared.hint("merge"), "band").select("band", "node", "leader"), "open0")  # two written tables: a hot band's partition is split at run time
    involved = open_rows.select("node").distinct().join(nodes.select("node", "r1", "r2").hint("merge"), "node")
    texts = scratch.write(rows.select("r1", "r2", "text").join(involved.hint("merge"), ["r1", "r2"]).groupBy("r1", "r2", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")
    scratch.drop("banded")
    scratch.release()

    pairs = scratch.write(open_rows.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs0")
    checked, links = pairs, scratch.write(verify(pairs, texts, threshold, width), "links0")
    for k in range(1, leader_rounds + 2):
        labels = components(links, scratch, f"labels{k}")
        left = open_rows.filter("node <> leader").select("band", "node").join(labels.hint("merge"), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        left = scratch.write(left, f"left{k}")
        several = scratch.write(left.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.min(F.struct("node", "label")).alias("lead")).filter("lo < hi"), f"several{k}")
        total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            break
        open_rows = scratch.write(join_facts(left, several, ["band"], "n", total).select("band", "node", "label", F.col("lead.node").alias("leader"), F.col("lead.label").alias("leader_label")), f"open{k}")
        if k > leader_rounds:
            links = links.unionByName(scratch.write(rest_links(open_rows.select("band", "node", "label"), texts, scratch, threshold, width, block), f"links{k}"))
            labels = components(links, scratch, "labels")
            break
        new = open_rows.filter("label <> leader_label").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        pairs = scratch.write(new.distinct().join(checked.hint("merge"), ["a", "b"], "left_anti"), f"pairs{k}")
        checked = checked.unionByName(pairs)
        links = links.unionByName(scratch.write(verify(pairs, texts, threshold, width), f"links{k}"))

    placed = nodes.select("key", "copies", "node", "doc_id").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = scratch.write(placed, "placed")
    classes = scratch.write(placed.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("keep"), F.sum("copies").alias("class_size"), F.count("*").alias("members")), "classes")
    facts = scratch.write(join_facts(placed, classes, ["label"], "members", placed.count()).select("key", "copies", "keep", "class_size"), "facts")
    out = join_facts(signed.select("key", "doc_id", "rid", "r1", "r2"), facts, ["key"], "copies", signed.count())
    return out.select("doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("keep.node")).alias("kept"), "r1", "r2")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input without all but one row of each class; columns unchanged."""
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(near_duplicates(docs, id_col=id_col, text_col=text_col, scratch=scratch, **parameters).filter("kept").select(F.col("r1").alias("__lq_r1"), F.col("r2").alias("__lq_r2")), "kept")
    r1, r2 = row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    names = docs.columns
    keyed = docs.withColumns({"__lq_r1": r1, "__lq_r2": r2}).join(kept.hint("merge"), ["__lq_r1", "__lq_r2"])
    one = keyed.groupBy("__lq_r1", "__lq_r2").agg(F.first(F.struct(*(F.col(f"`{c}`") for c in names))).alias("x"))
    return one.select(*(F.col("x").getField(c).alias(c) for c in names))
