"""Each operator against SQL or brute force, and on nulls, empty and long texts, repeated rows and clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiquarry.llm import queries as registered
from lexiquarry.llm.class_lm import class_lm_scores, exchange
from lexiquarry.llm.decontamination import _WORD, ItemIndex, decontaminate, find_contamination, shingles
from lexiquarry.llm.exact_dedup import exact_dedup
from lexiquarry.llm.html_extraction import Slot, extract_pages, matching, merge, weight
from lexiquarry.llm.language_id import fit, identify, train, training_row
from lexiquarry.llm.line_dedup import line_dedup
from lexiquarry.llm.near_dedup import block_links, near_dedup, near_duplicates, prob_minhash, probability_jaccard, weighted_shingles, word_hashes
from lexiquarry.llm.packing import WordTokenizer, cut_pieces, pack, pack_documents, sum_of_squares
from lexiquarry.llm.shared import Scratch
from lexiquarry.llm.sharding import byte_shards
from lexiquarry.llm.substring_dedup import substring_dedup

VOCABULARY, TOKENS = registered.tokenizer_file("piece_bpe_32k.model"), registered.tokenizer_file("word_bpe_49k.json")
LONG = "some words that go on " * 4000
ODD = [(1, "Same text here", "en"), (2, "same TEXT here", "en"), (None, "same text here", None), (3, None, "en"), (4, "", "de"), (5, "a\n\n b \nA", "de"), (5, "a\n\n b \nA", "de"), (6, LONG, "en"), (7, "?! 123", "en"), (None, None, None), (8, "日本 é x", "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in ("r1", "key", "band", "sha", "size", "batch", "m", "c", "word", "template", "r", "block")})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, sf, same, name):
    same(registered.queries()[name](spark, sf), registered.oracle_sql()[name])


def test_odd_rows(spark, sf, odd):
    n = len(ODD)
    empty = odd.limit(0)
    items = spark.createDataFrame([(1, "some words that go on some words that go on"), (2, None), (3, "?!"), (4, "same text here")], "item_id long, text string")
    assert exact_dedup(odd).count() == n and exact_dedup(empty).count() == 0
    kept = exact_dedup(odd).filter("kept").toPandas()
    assert len(kept) == kept.text_sha256.nunique() and exact_dedup(odd).filter("group_size = 3").select("keep_id").distinct().collect()[0][0] == 2
    assert byte_shards(odd, 3).count() == n and byte_shards(empty).count() == 0
    slots = byte_shards(odd, 3).toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in slots.groupby("shard").slot)
    lined = line_dedup(odd, min_docs=2)
    assert lined.count() == n and set(odd.columns) < set(lined.columns) and line_dedup(empty).count() == 0
    assert {r.text for r in lined.filter("doc_id in (1, 2, 5)").collect()} == {""}
    first = line_dedup(odd, min_docs=2, keep_first=True)
    assert first.filter("text <> ''").filter(F.lower("text") == "same text here").count() == 1
    model = fit(odd, VOCABULARY)
    tags = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in identify(odd, model).collect()}
    assert tags[3, None] == tags[7, "?! 123"] == tags[4, ""] == ("und", 0.0) and tags[6, LONG][0] == "en" and identify(empty, model).count() == 0
    assert {r.lang_pred for r in identify(odd, fit(empty, VOCABULARY)).collect()} == {"und"}
    scores = class_lm_scores(odd, words=20, classes=2, start=5).toPandas()
    assert len(scores) == n and np.isfinite(scores.score).all() and class_lm_scores(empty).count() == 0
    assert pack_documents(odd, TOKENS).groupBy("doc_id", "piece").count().count() >= 8 and pack_documents(empty, TOKENS).count() == 0
    near = near_duplicates(odd).toPandas()
    assert len(near) == n and near.kept.sum() == near_dedup(odd).count() and near_duplicates(empty).count() == 0
    assert near[near.doc_id == 1].class_size.iloc[0] == 3 and near_dedup(odd).columns == odd.columns
    found = {(r.doc_id, r.item_id) for r in find_contamination(odd, items).collect()}
    assert found == {(6, 1), (1, 4), (2, 4), (None, 4)} and find_contamination(empty, items).count() == 0 and find_contamination(odd, items.limit(0)).count() == 0
    assert decontaminate(odd, items).count() == n - 4 and decontaminate(odd, items, max_items=1).count() == n - 4
    cut = substring_dedup(odd).toPandas()
    assert len(cut) == n and cut.n_removed.sum() == 0 and substring_dedup(empty).count() == 0
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, sf).columns == odd.columns, name
        assert stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.packing(spark, odd, sf).count() >= n and corpus_pipeline.packing(spark, empty, sf).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "http://o.example/", ""), (1, "http://o.example/", ""), (2, "?", LONG), (3, "http://o.example/", "<p>" * 3000 + "x")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "template", "text", "salt")})
    assert sorted((r.page_id or 0, r.text) for r in extract_pages(pages).collect()) == [(0, ""), (1, ""), (1, ""), (2, LONG.strip()), (3, "x")] and extract_pages(pages.limit(0)).count() == 0


def test_exact_dedup_in_slices(spark, sf, same):
    """The filter cut into slices gives the same rows."""
    sliced = exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"), bits_per_row=1024, max_filter_bits=1 << 15)
    same(sliced, registered.oracle_sql()["op8_exact_dedup"])


@pytest.mark.parametrize("min_docs", [1, 2, 5])
def test_line_runs(spark, min_docs):
    """Levelled runs against a count of documents: compacted twice, saturated in one batch and over several."""
    rows = [(k, "\n".join(f"line {j}" for j in range(12) if k % (j + 1) == 0) + f"\nown {k}") for k in range(60)]
    held = collections.Counter(x for _, t in rows for x in set(t.split("\n")))
    for first in (False, True):
        got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=min_docs, keep_first=first).collect()}
        if not first:
            assert got == {k: "\n".join(x for x in t.split("\n") if held[x] < min_docs) for k, t in rows}
        else:
            left = collections.Counter(x for t in got.values() for x in t.split("\n") if x)
            assert left == {x: n if n < min_docs else 1 for x, n in held.items()}


def test_line_runs_merge_without_exchange(spark):
    """The plan of a batch against three runs, and of their compaction."""
    from lexiquarry.llm.line_dedup import RunStore
    from lexiquarry.llm.shared import Scratch

    store = RunStore(Scratch(spark), 3, 9, 4)
    batches = store.scratch.bucketed(spark.range(400).selectExpr("cast(cast(id % 90 as string) as binary) as key", "id", "cast(id % 4 as int) as batch").groupBy("batch", "key").agg(F.count("*").alias("n"), F.min("id").alias("id")), "counted", 4, "key", by=["batch"])
    plans = []
    store.scratch.bucketed, real = lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **k), store.scratch.bucketed
    for k in range(4):
        store.add(batches.filter(F.col("batch") == k).select("key", "n", F.struct("batch", "id").alias("first")))
    assert plans[3].count("SortMergeJoin") == 6 and "Exchange" not in plans[3] and "Sort " not in plans[3]
    merged = store.runs()[0].unionByName(store.runs()[1]).groupBy("key").agg(F.max("n"))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    want = collections.Counter(k % 90 for k in range(400))
    assert {(bytes(r.key), r.n >= 3) for r in store.frequent().collect()} == {(str(k).encode(), True) for k, n in want.items() if n >= 3}


def test_near_duplicates_equal_brute_force(spark, sf, docs):
    own = {d: (a[1], a[2]) for d, t in docs.items() for a in [weighted_shingles(*word_hashes([t]))]}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if len(np.intersect1d(own[x][0], own[y][0])) and probability_jaccard(own[x], own[y]) >= 0.8 - 1e-12:
                parent[root(x)] = root(y)
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for d in ids:
        want[root(d)].add(d)
    for r in registered.queries()["op10_near_dedup"](spark, sf).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    x, y = (np.sort(ids[:45]), rng.integers(1, 5, 45)), (np.sort(ids[15:]), rng.integers(1, 5, 45))
    sig = prob_minhash(np.repeat([0, 1], 45), np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2, 4096)
    exact = sum(1 / sum(max(a[j] / a[i] if j in a else 0, b[j] / b[i] if j in b else 0) for j in {*a, *b}) for a, b in [(dict(zip(*x)), dict(zip(*y)))] for i in {*a} & {*b})
    assert abs(probability_jaccard(x, y) - exact) < 1e-9 and abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_block_links_equal_pairs():
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :], *base[: k % 7]]) for k in range(0, 60, 3)] + ["", "a b", "a b"]
    part = [weighted_shingles(*word_hashes([t]))[1:] for t in texts]
    want = {(i, j) for i in range(10) for j in range(len(texts)) if probability_jaccard(part[i], part[j]) >= 0.8 - 1e-12}
    assert set(block_links(texts[:10], texts, 0.8, 5)) == want and len(want) > 10


def test_contamination_equals_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = ItemIndex(items)
    step, want = max(32, index.longest), set()
    for d, t in docs.items():
        words = _WORD.findall(t.lower())
        for at in range(0, max(1, len(words)), step):
            passage = shingles(words[at : at + 2 * step])
            want |= {(d, i.item_id) for i in index.items if i.overlap(passage)[0] >= 0.8 - 1e-9}
    assert {(r.doc_id, r.item_id) for r in registered.queries()["op1_decontamination"](spark, sf).collect()} == want and want


def test_contamination_by_short_questions(spark):
    """Items whose question has fewer words than a shingle: verbatim, and as near copies at the threshold."""
    items = [(1, "Who wrote it? Ann did."), (2, "Why? Because."), (3, "Who wrote it? Nobody knows that."), (4, "Where? In a house by the lake behind the old mill and two more barns to come."), (5, "Is it so? No."), (6, "This one has a long question of its own. Yes.")]
    words = {i: _WORD.findall(t.lower()) for i, t in items}
    texts = [f"before {t} after all" for _, t in items] + [" ".join([*words[4][:cut], "x"]) for cut in (15, 14, 13, 12)] + [" ".join(["x", *words[4][cut:], "y"]) for cut in (1, 2, 3)] + ["who wrote", "nothing"]
    want = set()
    for d, t in enumerate(texts):
        own = _WORD.findall(t.lower())
        for i, w in words.items():
            runs = shingles(w)
            n = len(next(iter(runs)))
            if len(runs & {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}) >= 0.8 * len(runs) - 1e-9:
                want.add((d, i))
    got = find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {(k, k + 1) for k in range(6)} < want
    assert all((r.overlap, r.question_overlap, r.answer_overlap) == (1, 1, 1) for r in got if r.doc_id == r.item_id - 1)
    assert all(i.question | i.answer == shingles(words[i.item_id]) for i in ItemIndex(items).items)


def test_language_of_held_out(spark, sf):
    got = registered.queries()["op2_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() > 0.95


def _enumerated(model, word):
    """log of the summed probability of all segmentations, each one listed."""
    word = " " + word
    ways = lambda i: [[]] if i == len(word) else [[(i, j), *rest] for j in range(i + 1, len(word) + 1) if word[i:j] in model.vocabulary or j == i + 1 for rest in ways(j)]
    p = lambda i, j: model.logp[model.vocabulary[word[i:j]]] if word[i:j] in model.vocabulary else model.unseen
    return np.log(sum(np.exp(sum(p(i, j) for i, j in way)) for way in ways(0)))


def test_segmentations_are_summed(spark, sf):
    """The forward algorithm and one round of learning against all segmentations, and a word of many letters."""
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"), VOCABULARY)
    words = ["the", "und", "x日y", "ouheti", "été", "straße", "q"]
    want = np.array([_enumerated(model, w) for w in words])
    assert np.allclose(model.words_logp(words), want, atol=1e-9) and np.allclose([model._long(w) for w in words], want, atol=1e-9)
    once, twice = "ouheti" * 20_000, "ouheti" * 40_000
    a, b = model.words_logp([once, twice])
    assert np.isfinite(b).all() and np.allclose(b, 2 * a, rtol=1e-3)
    vocabulary = {p: k for k, p in enumerate(["a", "b", "ab", " a", " "])}
    counts = np.array([[2.0, 0.0], [1.0, 3.0]])
    start = np.array([0.5 ** len(p) for p in vocabulary] + [1e-6])
    start = dict(zip([*vocabulary, None], start / start.sum()))
    learned = train(["ab", "ac"], counts, ["x", "y"], vocabulary, rounds=1)
    prior = np.array([4.0 ** -len(p) for p in vocabulary] + [0.01 / 4])  # three letters and the word mark
    expected = np.repeat((0.05 * 6 * prior / prior.sum())[:, None], 2, axis=1)
    for word, n in zip((" ab", " ac"), counts):
        ways = [w for k in range(1 << (len(word) - 1)) for w in [[word[i:j] for i, j in zip([0, *(x for x in range(1, len(word)) if k >> (x - 1) & 1)], [*(x for x in range(1, len(word)) if k >> (x - 1) & 1), len(word)])]] if all(p in vocabulary or len(p) == 1 for p in w)]
        mass = [math.prod(start[p if p in vocabulary else None] for p in w) for w in ways]
        for w, m in zip(ways, mass):
            for p in w:
                expected[vocabulary.get(p, 5)] += n * m / sum(mass)
    assert np.allclose(np.exp(np.vstack([learned.logp, learned.unseen])), expected / expected.sum(axis=0))


def test_language_of_numerals_and_null_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs, VOCABULARY)
    rows = [(1, "½ 12"), (2, "² Ⅷ"), (3, "the½and of the other"), (None, "the and of it"), (4, "xqzv kjwq zzxj qqkv wvxz"), (5, "и не только это"), (6, "")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all((got[k].lang_pred, got[k].score, got[k].lift) == ("und", 0.0, None) for k in (1, 2, 6)) and got[3].lang_pred == "en" and got[3].lift > 0
    assert got[4].lift < 0 and got[5].lift < 0
    flags = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", (~training_row()).alias("out")).collect()
    assert all(r.out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in flags)
    stage = corpus_pipeline.language_id(spark, docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-k, t, None) for k, t in rows[:4] + rows[4:] if k], "doc_id long, text string, lang string")), sf)
    assert {r.doc_id for r in stage.filter("doc_id < 0").collect()} == {-3}


def test_lm_counts_and_gain(spark, sf, docs):
    counts = collections.Counter()
    words = {d: [*t.encode().lower().split(), b" "] for d, t in docs.items()}
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(w)
    total, types = sum(counts.values()), len(counts)
    gain = 0.0
    for r in class_lm_scores(spark.read.parquet(f"{sf}/documents.parquet"), words=2000).collect():
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert abs(r.base_score - sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w)) < 1e-6 * len(w)
        gain += r.held_out * (r.score - r.base_score)
    assert gain > 0
    pairs = np.zeros((6, 6))
    pairs[:2, 2:4] = pairs[2:4, :2] = 10
    own = exchange(pairs, 2)
    assert own[0] == own[1] != own[2] == own[3]


def test_lm_score_is_moves_and_emissions(spark, sf, docs):
    """score against sums of log10 of class moves and word emissions from plain counts; probabilities sum to 1; the
    classes' bigrams that the rounds merge are those of the texts; the exchange ends above its start."""
    from lexiquarry.llm.class_lm import END, Pairs, objective, train
    from lexiquarry.llm.shared import Scratch

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    texts = frame.filter(~held).select(F.col("text").cast("binary").alias("text")).repartition(3)
    model, counted = train(texts, Scratch(spark), words=1500)
    size, k = len(model.index), int(model.classes[-1])
    tokens = {d: [*t.encode().lower().split(), END] for d, t in docs.items()}
    learned = [w for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = collections.Counter(x for w in learned for x in w)
    kind = lambda w: int(model.classes[model.index.get(w, size)])
    assert k + 2 == len(model.log_move) and k == max(2, round(len(counts) ** (1 / 3))) and {kind(w) for w in model.index} <= {*range(k), k + 1}
    moves = np.zeros((k + 2, k + 2))
    for w in learned:
        for a, b in zip([END, *w], w):
            moves[kind(a), kind(b)] += 1
    share = (moves.sum(axis=0) + 1) * np.isin(np.arange(k + 2), [*model.classes, k])
    share /= share.sum()
    whole = {c: sum(n for w, n in counts.items() if kind(w) == c) for c in range(k + 2)}
    rare = [w for w in counts if w not in model.index]
    p = lambda a, b: (moves[kind(a), kind(b)] + 5 * share[kind(b)]) / (moves[kind(a)].sum() + 5) * ((counts[b] + 1) / (whole[k] + len(rare) + 1) if kind(b) == k else counts[b] / whole[kind(b)])
    got = {r.doc_id: r.score for r in class_lm_scores(frame, words=1500).collect()}
    for d, w in tokens.items():
        assert abs(got[d] - sum(math.log10(p(a, b)) for a, b in zip([END, *w], w))) < 1e-6 * len(w)
    for a in (END, max(counts, key=counts.get), rare[0]):
        assert abs(sum(p(a, b) for b in counts) + p(a, b"\0 never seen") - 1) < 1e-9
    pairs = Pairs(texts, Scratch(spark), model, 3)
    sums, new = pairs.summed(model.classes, k + 2, moves, k, 3)
    assert (sums == moves).all() and (new[[model.index[END], size]] == [k + 1, k]).all()
    for _, m0, c0, n0, m1, c1, n1 in pairs.table.collect():
        assert m0 and m1
    start = np.where(model.classes < k, np.arange(size + 1) % k, model.classes)
    assert objective(moves) > objective(pairs.summed(start, k + 2)[0])


def test_exchange_recovers_classes(spark):
    """Words of three kinds that follow one another in turn: the exchange of the whole index finds the kinds, though it
    starts from a few words."""
    from lexiquarry.llm.class_lm import END, train
    from lexiquarry.llm.shared import Scratch

    import random

    draw = random.Random(2)
    words = {c: [f"{c}{j}" for j in range(60)] for c in "xyz"}
    rows = [(" ".join(draw.choice(words[c]) for _ in range(20) for c in "xyz").encode(),) for _ in range(150)]
    model, _ = train(spark.createDataFrame(rows, "text binary").repartition(4), Scratch(spark), classes=3, start=12)
    found = collections.defaultdict(set)
    for w, at in model.index.items():
        if w != END:
            found[int(model.classes[at])].add(w[:1])
    assert sorted(map(sorted, found.values())) == [[b"x"], [b"y"], [b"z"]]


def test_substrings_equal_brute_force(spark, sf, docs):
    got, seen = {r.doc_id: r for r in registered.queries()["op6_suffix_dedup"](spark, sf).collect()}, {}
    apart = substring_dedup(spark.read.parquet(f"{sf}/documents.parquet").repartition(9)).drop("kept")  # a block for each part
    assert {r.doc_id: r for r in apart.collect()} == got
    often = substring_dedup(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), hot=1).drop("kept")  # tuples at two places count as hot
    assert {r.doc_id: r for r in often.collect()} == got
    for d in sorted(docs):
        body = docs[d].encode()
        off = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - 49):
            if seen.setdefault(body[i : i + 50], d) < d:
                off[i : i + 50] = True
        kept = np.frombuffer(body, np.uint8)[~off[:-1]].tobytes()
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), off.sum(), np.count_nonzero(np.diff(off.astype(int), prepend=0) == 1), hashlib.sha256(kept).hexdigest())


def test_substrings_of_odd_rows_equal_brute_force(spark):
    """Null ids and texts, repeated rows, short, periodic and non-ASCII texts."""
    again = "some words that go on and on, "
    rows = [(5, again * 400), (3, again * 90), (3, again * 90), (None, again * 30), (None, again * 70), (7, None), (8, ""), (9, "x" * 49), (10, "x" * 50), (11, "x" * 500), (12, "é日本" * 40), (13, "a" + "é日本" * 40), (14, "q" * 20 + again * 5 + "z" * 60), (4, "z" * 80 + again * 6)]
    bodies, first = sorted((-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows), {}
    for d, body in bodies:
        for i in range(len(body) - 49):
            first.setdefault(body[i : i + 50], d)
    want = []
    for d, body in bodies:
        off = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - 49):
            off[i : i + 50] |= first[body[i : i + 50]] < d
        kept = np.frombuffer(body, np.uint8)[~off[:-1]].tobytes()
        want.append((d, len(body), int(off.sum()), int(np.count_nonzero(np.diff(off.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()))
    for hot in (1 << 15, 4, 0):
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).drop("kept").fillna(-(1 << 63), "doc_id")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), hot


def test_shards_of_repeated_and_huge_rows(spark):
    """Equal rows spread over blocks; a row larger than a shard; whole-number cuts as in the SQL."""
    rows = [(None, "same")] * 300 + [(7, "x" * 20_000)] + [(k, "y" * k) for k in range(40)]
    got = byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).toPandas()
    order = sorted((-1 if d is None else d, zlib.crc32(t.encode()), len(t) + 16) for d, t in rows)
    upto, total, want = 0, sum(x[2] for x in order), collections.Counter()
    for d, c, size in order:
        upto += size
        want[d, c, size, min(4, (2 * upto - size) * 5 // (2 * total))] += 1
    assert collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got.text_crc32, got["size"], got.shard)) == want
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer, got = Tokenizer.from_file(TOKENS), registered.queries()["op9_packing"](spark, sf).toPandas()
    for d, t in docs.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        own = got[got.doc_id == d].sort_values("piece")
        assert own.start.tolist() == list(range(0, len(ids), 4096)) and own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in own.start]
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all()
    assert order.groupby("sequence_id").length.sum().max() <= 4096 and got.sequence_id.nunique() <= 1.03 * got.length.sum() / 4096 + 1
    parts = pack(cut_pieces(spark.read.parquet(f"{sf}/documents.parquet"), TOKENS), Scratch(spark), group=50).toPandas()  # several groups
    order = parts.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all() and order.groupby("sequence_id").length.sum().max() <= 4096
    assert sorted(zip(parts.doc_id, parts.piece, parts.ids_crc32)) == sorted(zip(got.doc_id, got.piece, got.ids_crc32))
    bins, _ = sum_of_squares(np.array([3, 3, 3, 1, 1, 1]), 4)
    assert len(set(bins.tolist())) == 3
    mixed = WordTokenizer(TOKENS)
    for t in ("It's ½ x² _a\tÜber", "日本 <|endoftext|>", "a\x1cb \x7f"):
        assert mixed.ids(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _page(body, title="t"):
    return f'<html><head><title>{title}</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">{title} link</a></li></ul></nav>{body}<form>Name {title}<input></form><footer>&copy; {title}</footer></body></html>'


def test_html(spark, sf):
    bodies = [
        ("<article><h1>One &amp; two</h1><p><b>first<br><p>second  <i>x</i>\n y</p><div class='ad-box'>buy 1</div><p>All rights reserved.</p></article><aside>side</aside>", "One & two\nfirst\nsecond x y"),
        ("<article><h1>Three</h1><p>third &#233;&nbsp;z</p><!-- <p>no</p> --><p>All rights reserved.</p><section class=comments><p>me too</p></section></article>", "Three\nthird é z"),
        ("<div id=content><p>no article here</p></div>", None), ("", ""), (None, ""),
    ]
    rows = [(i, "http://h.example/p", None if b is None else _page(b, f"t{i}")) for i, (b, _) in enumerate(bodies)] + [(9, None, "plain text <b>only</b>")]
    for limit in (1 << 25, 0):
        got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit(1)), max_broadcast=limit).collect()}
        assert got[0].text == bodies[0][1] + "\nAll rights reserved." and got[1].text == bodies[1][1] + "\nAll rights reserved."  # on two of four contents
        assert got[4].text == "" and got[9].text == "plain text only" and all(r.n_chars == len(r.text) for r in got.values())
    for r in spark.read.parquet(f"{sf}/pages.parquet").join(registered.queries()["op3_html_extraction"](spark, sf).drop("url"), "page_id").collect():
        import html

        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def test_html_nested_blocks_equal_brute_force(spark):
    """Neighbours with the same key and children of several kinds: sections, table rows, lists, odd orders."""
    import random

    draw, rows, want = random.Random(3), [], {}
    for page in range(30):
        n = iter(range(10_000))
        word = lambda: f"w{page}x{next(n)} text"
        kinds = {
            "section": lambda: "".join(f"<{t}>{word()}</{t}>" for t in draw.choices(["h2", "p", "blockquote"], k=draw.randint(1, 6))),
            "tr": lambda: "".join(f"<{t}>{word()}</{t}>" for t in ["th", "td", "td"][: draw.randint(1, 3)]),
            "li": lambda: f"<p>{word()}</p><ul><li>{word()}</li><li><p>{word()}</p></li></ul>",
            "div": lambda: f"<h3>{word()}</h3>{word()}<p>{word()}</p><div><p>{word()}</p><h4>{word()}</h4></div>",
        }
        inner = "".join(hull[0] + "".join(f"<{t}>{kinds[t]()}</{t}>" for _ in range(draw.randint(2, 4))) + hull[1] for t, hull in [("section", ("", "")), ("tr", ("<table>", "</table>")), ("li", ("<ul>", "</ul>")), ("div", ("", ""))])
        rows.append((page, "http://n.example/p", _page(f"<article>{inner}</article>")))
        want[page] = "\n".join(x.strip() for x in re.split("<[^>]*>", inner) if x.strip())
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_html_mixed_layouts(spark):
    """Pages without an article beside many with one, and pages without a host that have nothing in common."""
    bodies = [(f"<article><h1>Title {k}</h1><p>story {k}</p></article>", f"Title {k}\nstory {k}") for k in range(20)] + [
        ("<div id=content><p>no article here</p></div>", "no article here"),
        ("<div class=about><p>About this house and all who live in it.</p></div><main><h1>Main</h1><p>text of main</p></main>", "Main\ntext of main"),
        ("<article> </article><div id=content><h2>Empty article</h2><p>text beside it</p></div>", "Empty article\ntext beside it"),
    ]
    for url in ("http://m.example/p", None):
        rows = [(i, url, _page(b, f"t{i}")) for i, (b, _) in enumerate(bodies)]
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: t for i, (_, t) in enumerate(bodies)}


def test_html_constant_and_varying_siblings(spark):
    """Neighbours with one key: what all pages have goes, what varies stays, wherever it stands; headings of the article
    stay; elements of an article whose names only look like those of side parts stay; so does a single page's text."""
    body = lambda k, n: f"<article><h1>The daily letter</h1><p>By our own staff.</p><h2>Summary</h2>{''.join(f'<p>story {k} part {j}, told at length</p>' for j in range(n))}<p>Share this!</p><div class='related-work'><h2>Related work</h2><p>others {k} did</p></div><div class='tags-and-promo'><p>kinds of {k}</p></div><div class='ad-box'>buy {k}</div><section class='comments'><p>so says {k}</p></section><p>All rights reserved.</p></article>"
    want = lambda k, n: "\n".join(["The daily letter", "Summary", *(f"story {k} part {j}, told at length" for j in range(n)), "Related work", f"others {k} did", f"kinds of {k}"])
    for pages in (2, 3, 5, 40):
        rows = [(k, "http://s.example/p", _page(body(k, 2 + k % 4), f"t{k}")) for k in range(pages)]
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
        assert got == {k: want(k, 2 + k % 4) for k in range(pages)}, pages
    alone = extract_pages(spark.createDataFrame([(1, "http://s.example/p", _page(body(1, 2)))], "page_id long, url string, html string")).collect()[0].text
    assert alone.startswith("The daily letter\nBy our own staff.\nSummary\nstory 1") and alone.endswith("All rights reserved.")


def test_html_deep_elements(spark):
    """A menu and text far below the depth to which elements are aligned one by one."""
    for depth in (150, 250, 3000):
        deep = "<div>" * depth
        rows = [(k, "http://d.example/p", _page(f"<article><h1>t{k}</h1>{deep}first {k}<nav><ul><li>menu {k}</li></ul></nav><p>second {k}</p>third {k}{'</div>' * depth}<p>last {k}</p></article>")) for k in range(4)]
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: f"t{k}\nfirst {k}\nsecond {k}\nthird {k}\nlast {k}" for k in range(4)}, depth


def test_html_matching_equals_all_matchings():
    """Simple tree matching against every order-preserving pairing, on small random trees."""
    import random

    draw = random.Random(5)
    tree = lambda d: Slot(draw.choice("abc"), [tree(d - 1) for _ in range(draw.randint(0, 3) if d else 0)])

    def best(a, b):
        if not a or not b:
            return 0
        pair = 1 + best(a[0].children, b[0].children) + best(a[1:], b[1:]) if a[0].key == b[0].key else 0
        return max(pair, best(a[1:], b), best(a, b[1:]))

    for _ in range(300):
        x, y = Slot("r", [tree(2) for _ in range(3)]), Slot("r", [tree(2) for _ in range(3)])
        assert weight(x, y, {}) == 1 + best(x.children, y.children)
        pairs = matching(x.children, y.children, {})
        assert sum(weight(x.children[i], y.children[j], {}) for i, j in pairs) == best(x.children, y.children)
        nodes = lambda s: 1 + sum(nodes(c) for c in s.children)
        assert nodes(merge(x, y)) == nodes(x) + nodes(y) - weight(x, y, {})


def test_html_copies_are_no_template(spark):
    """What only the copies of one article have is its text; what most different pages of the host have is not."""
    end = "<footer class=x></footer><h6>All rights reserved.</h6>"
    long = lambda first: f"<article><h1>Long</h1><p>{first}</p><table><tr><td>cell</td></tr></table><h2>Part</h2><p>more</p><blockquote>quote</blockquote><ul><li>item</li></ul>{end}</article>"
    text = lambda first: f"Long\n{first}\ncell\nPart\nmore\nquote\nitem"
    bodies = [(f"<article><h1>Title {k}</h1><p>story {k}</p>{end}</article>", f"Title {k}\nstory {k}") for k in range(100)]
    bodies += [(long("copied"), text("copied"))] * 120 + [(long(f"near {k}"), text(f"near {k}")) for k in range(9)]
    for titles in (1, 7):
        rows = [(i, "http://c.example/p", _page(b, f"t{i % titles}")) for i, (b, _) in enumerate(bodies)]
        got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
        assert got == {i: t for i, (_, t) in enumerate(bodies)}


def test_pipeline(spark, sf, docs):
    base = spark.read.parquet(f"{sf}/documents.parquet")
    tagged = corpus_pipeline.language_id(spark, base, sf)
    assert {r.doc_id for r in tagged.collect()} == {d for d, t in docs.items() if re.search(r"[^\W\d_]", t)}
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, base, sf).collect()}
    assert clean == set(docs) - {r.doc_id for r in registered.queries()["op1_decontamination"](spark, sf).collect()}
    lined = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, base, sf).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    held = collections.Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    left = collections.Counter(k for t in lined.values() for k in {key(x) for x in t.split("\n")} if k)
    assert left == {k: n if n < 10 else 1 for k, n in held.items()}
    for d, t in docs.items():
        rare = [x for x in t.split("\n") if held[key(x)] < 10]
        own = [x for x in lined.get(d, "").split("\n") if held[key(x)] < 10]
        assert own == rare or d not in lined and not "".join(rare).strip()
    classes = collections.defaultdict(list)
    for r in registered.queries()["op10_near_dedup"](spark, sf).collect():
        classes[r.class_id].append(r.doc_id)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, base, sf).collect()} == {min(v) for v in classes.values()}
    pieces = corpus_pipeline.packing(spark, base, sf).toPandas()
    assert set(pieces.doc_id) == set(docs) and pieces.groupby("sequence_id").length.sum().max() <= 4096
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < out.doc_id.nunique() < len(docs) and out.groupby("sequence_id").length.sum().max() <= 4096


def test_language_stage_sends_texts_once(spark):
    """Python gets the table's own columns, each once; names that the operator uses itself pass through."""
    rows = [(i, "the words of this text are plain", "en", 0.5) for i in range(20)] + [(20, None, "en", 0.5), (21, "123", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred double")
    out = corpus_pipeline.language_id(spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.nodeName() != "MapInArrow":
        node = node.children().head()
    assert node.children().head().output().size() == 4
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[:20]


def test_html_template_texts_counted_whole(spark):
    """More template texts in a slot than any fixed number, on a host with more contents than any sample; and a text
    on a bit under the share of the contents, which a sample of them may take for template."""
    notes = "".join(f"<li>house rule {k} of this site</li>" for k in range(150))
    body = lambda i: "".join(f"<p>page {i} says sentence {i * 7 + k} here in its own words and goes on</p>" for k in range(150))
    near = lambda i: "<blockquote>now and then</blockquote>" if i % 100 < 57 else f"<blockquote>quote {i}</blockquote>"
    rows = [(i, "http://h/x", f"<article>{body(i)}{near(i)}<ul>{notes}</ul></article>") for i in range(200)]
    for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect():
        assert "house rule" not in r.text and ("now and then" in r.text) == (r.page_id % 100 < 57) and r.text.count("says sentence") == 150
