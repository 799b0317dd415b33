"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability
of a word is the sum over all its segmentations into pieces, by a forward algorithm; a text's
is the product over its words. Expectation maximisation fits the pieces from word counts of
labelled texts: forward-backward inside tasks, one sum per language and piece between rounds.

FIT_ROWS bounds the labelled rows of a language that are fitted on; the model is bounded by the vocabulary
times the number of languages. Scoring covers every word of every text.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm import common

#: Labelled rows of each language that the model is fitted on, at most (in expectation), by a hash of the id.
FIT_ROWS = 500
ROUNDS = 2
#: Probability of a single letter outside the vocabulary, and the floor of a piece in a language that never used it.
FLOOR = 1e-7
#: Words that a worker remembers, and the letters of the longest one; the memory is emptied when full, longer words are scored anew.
KEPT_WORDS, KEPT_LETTERS = 200_000, 64
#: Letters up to which the fit multiplies plain doubles; FLOOR to this power is one.
PLAIN_LETTERS = 40
#: Positions after which a forward pass is scaled; FLOOR to this power is far above the smallest double.
STRETCH = 16

_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def runs_of_letters(text: str) -> list[str]:
    """Lower-case runs of letters with a word-start mark."""
    return ["\u2581" + w for w in _WORDS.findall(text.lower())]


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of the public vocabulary at path, in its order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    return [p for p in pieces if p == "\u2581" or (q := p.removeprefix("\u2581")) and q == q.lower() and _WORDS.fullmatch(q)]


class Pieces:
    """Pieces with a row of probabilities each: row 0 is no piece, row 1 a letter outside the vocabulary."""

    def __init__(self, model: dict[str, tuple[float, ...]], n: int):
        self.at = {p: k for k, p in enumerate(model, 2)}
        self.rows = np.array([(0.0,) * n, (FLOOR,) * n, *model.values()]).reshape(len(model) + 2, n)
        self.longest = max(map(len, model), default=1)

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, summed over all segmentations; words of one length advance together."""
        out = np.zeros((len(words), self.rows.shape[1]))
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for length, which in by_length.items():
            out[which] = self._forward([words[k] for k in which], length)
        return out

    def _forward(self, words: list[str], length: int) -> np.ndarray:
        """The forward pass over words of one length; only the last `longest` positions are held, and scaled every STRETCH."""
        get, n = self.at.get, self.rows.shape[1]
        alpha, scale = {0: np.ones((len(words), n))}, np.zeros((len(words), n))
        for first in range(1, length + 1, STRETCH):
            spans = [(i, j) for j in range(first, min(first + STRETCH, length + 1)) for i in range(max(0, j - self.longest), j)]
            at = np.fromiter((get(w[i:j], 0) for i, j in spans for w in words), np.int32, len(spans) * len(words)).reshape(len(spans), len(words))
            for (i, j), x in zip(spans, at):
                if j not in alpha:
                    alpha[j] = np.zeros((len(words), n))
                if i == j - 1:
                    x = np.where(x == 0, 1, x)
                elif not x.any():
                    continue
                alpha[j] += alpha[i] * self.rows[x]
            end = spans[-1][1]
            alpha = {k: v for k, v in alpha.items() if k > end - self.longest}
            top = np.max(list(alpha.values()), axis=0)
            scale += np.log(top)
            for v in alpha.values():
                v /= top
        return scale + np.log(alpha[length])


def log_likelihoods(word: str, model: dict[str, tuple[float, ...]], longest: int, n: int) -> tuple[float, ...]:
    """Log probability of one word in each language."""
    return tuple(Pieces({p: v for p, v in model.items() if len(p) <= longest}, n).log_likelihoods([word])[0].tolist())


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def expected_counts(word: str, probs: dict[str, float], longest: int) -> dict[str, float]:
    """Expected number of uses of each piece in a word, by forward-backward; letters outside the vocabulary count as FLOOR.

    Words of more than PLAIN_LETTERS letters, whose product of floors may be no double, are summed in logarithms.
    """
    n, get = len(word), probs.get
    ends = []
    for j in range(1, n + 1):
        here = [(i, p) for i in range(max(0, j - longest), j) if (p := get(word[i:j], 0.0)) > 0]
        if word[j - 1 : j] not in probs:
            here.append((j - 1, FLOOR))
        ends.append(here)
    out: dict[str, float] = defaultdict(float)
    if n <= PLAIN_LETTERS:
        alpha = [1.0]
        for here in ends:
            alpha.append(sum([alpha[i] * p for i, p in here]))
        beta = [0.0] * n + [1.0]
        for j in range(n, 0, -1):
            for i, p in ends[j - 1]:
                if x := alpha[i] * p * beta[j]:
                    out[word[i:j]] += x / alpha[-1]
                beta[i] += p * beta[j]
        return out
    none = -math.inf
    logs = [0.0]
    for here in ends:
        ways = [logs[i] + math.log(p) for i, p in here if logs[i] > none]
        logs.append(_log_sum(ways) if ways else none)
    after: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
    for j in range(n, 0, -1):
        if after[j] and logs[-1] > none:
            beta = _log_sum(after[j])
            for i, p in ends[j - 1]:
                after[i].append(math.log(p) + beta)
                if logs[i] > none:
                    out[word[i:j]] += math.exp(logs[i] + math.log(p) + beta - logs[-1])
    return out


class Model:
    def __init__(self, langs: list[str], priors: list[float], pieces: dict[str, tuple[float, ...]]):
        self.langs, self.priors, self.pieces = langs, priors, pieces


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        cols = [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w) for w in runs_of_letters(text))
        if len(counts) > 200_000:
            yield flush()
            counts.clear()
    yield flush()


def fit(labelled: DataFrame, path: str) -> Model:
    """Fit on rows (doc_id, text, lang); rows without a text or lang are ignored, repeated ones count as often as they occur.

    Of a language with more than FIT_ROWS rows a sample of about so many is taken, so every
    language has its share. A language whose rows hold no word keeps the floor of every piece.
    Words of any length are summed over all segmentations.
    """
    common.small_batches(labelled.sparkSession)
    labelled = labelled.where("text is not null and lang is not null")
    langs = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(langs.values())
    names = sorted(langs)
    pieces = vocabulary(path)
    if not total:
        return Model([], [], {})
    shares = F.create_map([F.lit(v) for x, n in langs.items() for v in (x, min(1.0, FIT_ROWS / n))])
    some = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.element_at(shares, F.col("lang")) * (1 << 20))
    counts = common.materialize(some.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    probs: dict[str, dict[str, float]] = {x: dict.fromkeys(pieces, 1 / len(pieces)) for x in names}
    for _ in range(ROUNDS):
        now, longest = probs, {x: max(map(len, p)) for x, p in probs.items()}

        def expect(batches: Iterator[pa.RecordBatch], now=now, longest=longest) -> Iterator[pa.RecordBatch]:
            uses: dict[tuple[str, str], float] = defaultdict(float)
            for batch in batches:
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    for piece, x in expected_counts(word, now[lang], longest[lang]).items():
                        if piece in now[lang]:
                            uses[lang, piece] += n * x
            cols = [[k[0] for k in uses], [k[1] for k in uses], list(uses.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["lang", "piece", "x"])

        summed = counts.mapInArrow(expect, "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        used: dict[str, dict[str, float]] = {x: {} for x in names}
        for r in summed.collect():
            used[r.lang][r.piece] = r.x
        probs = {x: {p: n / max(sum(u.values()), 1e-9) for p, n in u.items()} or {pieces[0]: FLOOR} for x, u in used.items()}
    known = sorted(set().union(*probs.values()))
    return Model(names, [math.log(langs[x] / total) for x in names], {p: tuple(max(probs[x].get(p, 0.0), FLOOR) for x in names) for p in known})


class _Scorer:
    """Sums the words' rows of log probabilities; new words of a batch are scored together."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces, len(model.langs))
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior of each text; give a bounded slice, as new words of all its texts are scored together."""
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        split = [runs_of_letters(t) if t else [] for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.known, self.rows = {}, self.rows[:0]
        new = set().union(*split).difference(self.known)
        long = {w for w in new if len(w) > KEPT_LETTERS}
        brief = list(new - long)
        self.known.update(zip(brief, range(len(self.rows), len(self.rows) + len(brief))))
        self.rows = np.concatenate([self.rows, self.pieces.log_likelihoods(brief)])
        out = []
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.model.priors + np.zeros(self.rows.shape[1])
            if long and not long.isdisjoint(words):
                for w, n in Counter(w for w in words if w in long).items():
                    total += n * self.pieces.log_likelihoods([w])[0]
                words = [w for w in words if w not in long]
            total += self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.model.langs[best], float(share[best] / share.sum())))
        return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score (the posterior of lang_pred) to docs, in place of columns of those names.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Of
    equally likely languages the first in alphabetical order is taken. Only `text` is read.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(sent.value)
        for batch in common.slices(batches, "text"):
            found = scorer.score(batch.column("text").to_pylist())
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_and_identify(docs: DataFrame, path: str) -> DataFrame:
    """Fit on the documents that are not held out, then identify every document.

    A row without a doc_id is not held out.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), path)
    return identify(docs, model)
