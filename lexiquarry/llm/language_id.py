"""Language ID with segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

_RUN = re.compile(r"[^\W\d_]+")
_CACHE: dict[bytes, dict[str, bytes]] = {}


def words_of(text: str) -> tuple[list[str], int]:
    """The runs of letters (Unicode categories L*) in lower case, and how many letters they have. _RUN also takes
    numerals that are no decimal digits, such as fractions; these part words."""
    words = _RUN.findall(text.lower())
    joined = "".join(words)
    if joined and not joined.isalpha():
        words = ["".join(run) for w in words for letters, run in itertools.groupby(w, str.isalpha) if letters]
        return words, sum(map(len, words))
    return words, len(joined)


def read_vocabulary(path: str) -> dict[str, int]:
    """The pieces of a sentencepiece model that are letters only; a leading word mark stays as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).replace("▁", " ").lower()
        if piece.removeprefix(" ").isalpha() and not model.is_control(i) and not model.is_byte(i):
            found.setdefault(piece, len(found))
    return found


class Lattice:
    """All pieces in some words, each word with its mark in front, and all their single characters: edges between
    places of the joined words, in the order of the place within the word at which they end."""

    def __init__(self, words: list[str], automaton):
        text = "\n".join([" " + w for w in words])
        size = np.array([len(w) + 1 for w in words])
        self.first = (np.cumsum(size + 1) - size - 1).astype(np.int32)
        self.last, self.places = (self.first + size).astype(np.int32), len(text) + 2
        found = np.fromiter(itertools.chain.from_iterable((e, n, k) for e, (n, k) in automaton.iter(text)), dtype=np.int32).reshape(-1, 3)
        end, length, piece = found[:, 0] + 1, found[:, 1], found[:, 2]
        bare = np.ones(self.places, dtype=bool)  # ends of characters without a piece of their own
        bare[0] = bare[end[length == 1]] = False
        bare[self.last + 1] = False
        own = np.flatnonzero(bare[: len(text) + 1]).astype(np.int32)
        end, length, piece = np.concatenate([end, own]), np.concatenate([length, np.ones(len(own), np.int32)]), np.concatenate([piece, np.full(len(own), -1, np.int32)])
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), size + 1)
        step = end - self.first[self.word[end - 1]]
        order = np.lexsort((end, step))
        self.end, self.start, self.piece = end[order], (end - length)[order], piece[order]
        self.cuts = np.append(np.flatnonzero(np.diff(step[order], prepend=-1)), len(order))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """By place and language the summed probability of all ways to it from its word's start; prob: of each edge."""
        alpha = np.zeros((self.places, prob.shape[1]))
        alpha[self.first] = 1.0
        for lo, hi in zip(self.cuts, self.cuts[1:]):
            to, at = np.unique(self.end[lo:hi], return_index=True)
            alpha[to] = np.add.reduceat(alpha[self.start[lo:hi]] * prob[lo:hi], at, axis=0)
        return alpha

    def backward(self, prob: np.ndarray) -> np.ndarray:
        """The same of all ways to its word's end."""
        beta = np.zeros((self.places, prob.shape[1]))
        beta[self.last] = 1.0
        for lo, hi in zip(self.cuts[-2::-1], self.cuts[:0:-1]):
            np.add.at(beta, self.start[lo:hi], beta[self.end[lo:hi]] * prob[lo:hi])
        return beta


@dataclass
class PieceModel:
    """By piece and language, log probabilities; `unseen` for one character without a piece; how many different
    characters the learned words have."""

    vocabulary: dict[str, int]
    langs: list[str]
    logp: np.ndarray  # pieces x languages
    unseen: np.ndarray  # languages
    letters: int = 1

    def words_logp(self, words: list[str]) -> np.ndarray:
        """By word and language log P(word | language), summed over all segmentations by the forward algorithm.

        All pieces of all words are found in one pass of an automaton; the algorithm then steps through
        the words' places for all words at once. Words too long for that are done one by one."""
        out = np.empty((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= 60]
        if short:
            lattice = Lattice([words[i] for i in short], self.automaton)
            with np.errstate(divide="ignore"):
                out[short] = np.log(lattice.forward(self.prob[lattice.piece])[lattice.last])
        for i, w in enumerate(words):
            if len(w) > 60 or not np.isfinite(out[i]).all():
                out[i] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same for a word of any length: only the last places' sums are held, scaled by language."""
        text, size = " " + word, max(map(len, self.vocabulary), default=1) + 1
        alpha, scale = np.zeros((size, len(self.langs))), np.zeros(len(self.langs))
        alpha[0], prob = 1.0, self.prob
        hits, hit = self.automaton.iter(text), None
        hit = next(hits, None)
        for j in range(1, len(text) + 1):
            row, single = np.zeros(len(self.langs)), False
            while hit is not None and hit[0] == j - 1:
                length, piece = hit[1]
                row += alpha[(j - length) % size] * prob[piece]
                single |= length == 1
                hit = next(hits, None)
            alpha[j % size] = row if single else row + alpha[(j - 1) % size] * prob[-1]
            if j % 16 == 0:
                most = alpha.max(axis=0)
                alpha /= most
                scale += np.log(most)
        return scale + np.log(alpha[len(text) % size])

    @cached_property
    def prob(self) -> np.ndarray:
        return np.exp(np.vstack([self.logp, self.unseen]))  # the last row stands for -1

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for piece, k in self.vocabulary.items():
            found.add_word(piece, (len(piece), k))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("prob", "automaton")}


def train(words: list[str], counts: np.ndarray, langs: list[str], vocabulary: dict[str, int], rounds: int = 3, smooth: float = 0.05, chunk: int = 4000) -> PieceModel:
    """Expectation maximisation of each language's piece probabilities on words counted by language.

    Places are scaled by a constant a letter, which leaves the posteriors as they are. A word so long that its sums
    leave the range of floating-point numbers all the same is learned from in parts of 64 letters."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    words, counts = [words[i] for i in order], counts[order]
    size, n_langs = len(vocabulary), len(langs)
    model = PieceModel(vocabulary, langs, np.zeros((size, n_langs)), np.zeros(n_langs), max(1, len(set("".join(words)))))
    parts = [(w[k : k + 64], i) for i, w in enumerate(words) for k in range(0, len(w), 64)]
    lattices = [(Lattice([w for w, _ in parts[at : at + chunk]], model.automaton), np.array([i for _, i in parts[at : at + chunk]], dtype=np.int32)) for at in range(0, len(parts), chunk)]
    del parts
    length = np.array([len(p) for p in sorted(vocabulary, key=vocabulary.get)] + [1])
    prior = np.power(1.0 / (model.letters + 1), length)  # of pieces never seen: no likelier than letters drawn evenly
    prior[-1] *= 0.01
    prior *= smooth * (size + 1) / prior.sum()
    prob = np.power(0.5, length)
    prob[-1] = 1e-6
    prob = np.repeat((prob / prob.sum())[:, None], n_langs, axis=1)
    for _ in range(rounds):
        expected, scaled = np.repeat(prior[:, None], n_langs, axis=1), prob * np.power(8.0, length)[:, None]
        for lattice, at in lattices:
            p, n = scaled[lattice.piece], counts[at]
            forward, backward = lattice.forward(p), lattice.backward(p)
            whole = np.divide(n, forward[lattice.last], out=np.zeros(n.shape), where=n > 0)
            share = forward[lattice.start] * p * backward[lattice.end] * whole[lattice.word[lattice.end - 1]]
            for k in range(n_langs):
                expected[:, k] += np.bincount(np.where(lattice.piece < 0, size, lattice.piece), weights=share[:, k], minlength=size + 1)
        prob = expected / expected.sum(axis=0)
    if n_langs:
        model.logp, model.unseen = np.log(prob[:-1]), np.log(prob[-1])
    return model


def _count_words(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, w) for w in words_of(text)[0])
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, vocabulary_path: str, max_rows: int = 8000) -> PieceModel:
    """Learns from (text, lang) rows: about max_rows of them at most, taken by a hash of the text, with all their
    words and languages. The words of the rows taken are counted in the cluster; the counts come to the driver."""
    scratch = Scratch(labelled.sparkSession)
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    n = rows.count()
    share = min(1.0, max_rows / max(1, n))
    taken = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)) if share < 1 else rows
    found = scratch.write(_count_words(taken), "words").toArrow()
    words, langs = (found.column(c).combine_chunks().dictionary_encode() for c in ("word", "lang"))
    names = langs.dictionary.to_pylist()
    place = np.argsort(np.argsort(np.array(names, dtype=object))) if names else np.zeros(0, np.int64)
    counts = np.zeros((len(words.dictionary), len(names)))
    counts[words.indices.to_numpy(), place[langs.indices.to_numpy()]] = found.column("n").to_numpy()
    return train(words.dictionary.to_pylist(), counts, sorted(names), read_vocabulary(vocabulary_path))


def identify(docs: DataFrame, model: PieceModel, text_col: str = "text", cache_words: int = 400_000) -> DataFrame:
    """The input's columns and lang_pred, score (the language's posterior under equal priors, 0 to 1) and lift: by how
    much a character is likelier, in log, under that language than under letters drawn evenly. Text of a learned
    language has a lift over 0; random letters and other scripts don't.

    A word's probability sums all its segmentations; a text's is the product over all its words, however
    long it is. Letters are those of Unicode; numerals such as fractions aren't. `und` with score 0 and a null lift:
    a null or empty text, one without letters, or no language learned. Ties, that is equal posteriors: the first
    language by name. Repeated rows get equal results; an empty table gives an empty result. Columns keep their
    names; lang_pred, score and lift are replaced if the input has them."""
    names = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score", "lift")]
    key = uuid.uuid4().bytes
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages: bounded

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        if key not in _CACHE:
            _CACHE.clear()
        cache, even = _CACHE.setdefault(key, {}), math.log(model.letters + 1)  # the word mark counts as a letter
        for batch in batches:
            preds, scores, lifts = [], [], []
            texts = batch.column(at_text)
            for at in range(0, len(texts), 128):
                found = [words_of(t.as_py()) if t.is_valid and model.langs else ([], 0) for t in texts[at : at + 128]]
                new = list(set().union(*(w for w, _ in found)).difference(cache))
                if len(cache) + len(new) > cache_words:
                    cache.clear()
                    new = list(set().union(*(w for w, _ in found)))
                if new:
                    cache.update(zip(new, (x.tobytes() for x in model.words_logp(new))))
                for words, letters in found:
                    if not words:
                        preds.append("und"), scores.append(0.0), lifts.append(None)
                        continue
                    total = np.frombuffer(b"".join(map(cache.__getitem__, words))).reshape(len(words), -1).sum(axis=0)
                    best = int(total.argmax())
                    preds.append(model.langs[best]), scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                    lifts.append(float(total[best]) / (len(words) + letters) + even)
            columns = [*batch.columns[: len(names)], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(lifts, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(names)], "lang_pred", "score", "lift"])

    kept = docs.select(*names)
    at_text = kept.columns.index(text_col) if text_col in kept.columns else len(names)  # a text among the columns is sent once
    fields = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("lift", "double")
    sent = kept if at_text < len(names) else docs.select(*names, F.col(f"`{text_col}`").alias("__lq_text"))
    return sent.mapInArrow(tag, fields)


def training_row(id_col: str = "doc_id", modulus: int = 4, held_out: int = 2) -> Column:
    """Rows to learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus != held_out
