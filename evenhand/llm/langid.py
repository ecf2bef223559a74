"""Language identification with segmentation-marginalised unigrams.

A word is a lower-cased run of letters behind a word mark. Each language has a probability for every piece of a
fixed public vocabulary (its letter-only pieces, and one piece for letters that it lacks). The likelihood of a
word is the sum over all its segmentations into pieces of the product of the pieces' probabilities, computed by
a forward pass over the word's lattice; a text's is the product over its words. Probabilities are learned by
expectation-maximisation over the distinct words of every language, with their counts, of all training texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import held_out, shielded, vocabulary_path, written

MARK = "▁"
UNDETERMINED = "und"
ROUNDS = 2
#: Added to every expected count, so that no piece is impossible in a language.
PRIOR = 0.1
#: To be scored, words up to this length go through the lattice in arrays, longer ones one by one through a window.
ARRAY_LENGTH = 64
#: Probabilities are multiplied by this for each letter, so that products of many stay in range.
SCALE = np.exp(2.5)
#: Sums beyond these are rescaled while a word is passed.
LEAST, MOST = 1e-100, 1e100
WORDS_HELD = 200_000
_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; what counts as part of a word but is no letter, such as a superscript digit, ends a run."""
    out = []
    for run in _RUNS.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


class Lattice:
    """The vocabulary as a trie in arrays, and sums over all segmentations of words."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        raw = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        pieces = sorted({p for p in raw if p.lower() == p and (p == MARK or p.removeprefix(MARK).isalpha())} | {MARK})
        self.unknown = 0
        self.size = len(pieces) + 1
        letters = sorted(set("".join(pieces)))
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        self.piece_at = [-1]
        for n, piece in enumerate(pieces, 1):
            at = 0
            for c in piece:
                step = (at, self.code[c])
                if step not in nodes:
                    nodes[step] = len(self.piece_at)
                    self.piece_at.append(-1)
                at = nodes[step]
            self.piece_at[at] = n
        self.nodes = nodes
        keys = np.array([a * self.width + c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), dtype=np.int64)[order]
        self.ends = np.array(self.piece_at)
        self.longest = max(map(len, pieces))
        self.lengths = np.array([1, *map(len, pieces)])
        self.covered = np.zeros(self.width, bool)
        for c, k in self.code.items():
            self.covered[k] = self.ends[nodes[(0, k)]] >= 0 if (0, k) in nodes else False

    def matches(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of marked words of one length, by start."""
        length = len(words[0])
        text = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length)
        points, back = np.unique(text, return_inverse=True)
        codes = np.array([self.code.get(chr(p), 0) for p in points], dtype=np.int64)[back].reshape(text.shape)
        found = []
        everyone = np.arange(len(words))
        for start in range(length):
            lacking = ~self.covered[codes[:, start]]
            if lacking.any():
                rows = everyone[lacking]
                found.append((start, start + 1, rows, np.full(len(rows), self.unknown)))
            rows, state = everyone, np.zeros(len(words), np.int64)
            for end in range(start + 1, min(start + self.longest, length) + 1):
                key = state * self.width + codes[rows, end - 1]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                on = self.keys[at] == key
                rows, state = rows[on], self.to[at[on]]
                if not len(rows):
                    break
                piece = self.ends[state]
                whole = piece >= 0
                if whole.any():
                    found.append((start, end, rows[whole], piece[whole]))
        return found

    def scaled(self, probability: np.ndarray) -> np.ndarray:
        return probability * (SCALE ** self.lengths)[:, None]

    def log_likelihood(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """(words, languages) log-likelihoods; ``probability`` is (pieces, languages)."""
        scaled = self.scaled(probability)
        out = np.empty((len(words), probability.shape[1]))
        for rows, marked in by_length(words):
            length = len(marked[0])
            if length > ARRAY_LENGTH:
                for r, w in zip(rows, marked, strict=True):
                    out[r] = self.long_word(w, scaled)
            else:
                forward = np.zeros((length + 1, len(marked), probability.shape[1]))
                forward[0] = 1
                offset = np.zeros(forward.shape[1:])
                at = 0
                for start, end, own, piece in self.matches(marked):
                    if start > at:
                        at = start
                        rescale(forward[at : at + self.longest + 1], offset)
                    forward[end, own] += forward[start, own] * scaled[piece]
                out[rows] = np.log(forward[length]) + offset
            out[rows] -= length * np.log(SCALE)
        return out

    def long_word(self, word: str, scaled: np.ndarray) -> np.ndarray:
        """The forward pass over one long word; sums are rescaled at every letter. Without the scale's share."""
        ahead = [np.zeros(scaled.shape[1]) for _ in range(self.longest + 1)]
        ahead[0] = np.ones(scaled.shape[1])
        offset = np.zeros(scaled.shape[1])
        codes = [self.code.get(c, 0) for c in word]
        for start in range(len(codes)):
            here = ahead[0]
            if not self.covered[codes[start]]:
                ahead[1] = ahead[1] + here * scaled[self.unknown]
            state = 0
            for k, c in enumerate(codes[start : start + self.longest], 1):
                state = self.nodes.get((state, c), -1)
                if state < 0:
                    break
                if self.piece_at[state] >= 0:
                    ahead[k] = ahead[k] + here * scaled[self.piece_at[state]]
            top = np.max(ahead[1:], axis=0)
            offset += np.log(top)
            ahead = [a / top for a in ahead[1:]] + [np.zeros(scaled.shape[1])]
        return offset + np.log(ahead[0])

    def _sums(self, length: int, words: int, steps: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """(length + 1, words) logarithms of the sums up to every place; ``steps`` (start, end, rows, factor) by start."""
        sums = np.zeros((length + 1, words))
        sums[0] = 1
        offset = np.zeros(words)
        offsets = np.zeros((length + 1, words))
        at = 0
        for start, end, r, q in steps:
            if start > at:
                at = start
                rescale(sums[at : at + self.longest + 1], offset)
                offsets[at] = offset
            sums[end, r] += sums[start, r] * q
        offsets[length] = offset
        with np.errstate(divide="ignore"):  # a share that vanishes beside the others of its word
            return np.log(sums) + offsets

    def expected(self, words: list[str], counts: np.ndarray, language: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """(pieces, languages) expected uses of the pieces; each word, however long, counts for its own language only."""
        scaled = self.scaled(probability)
        languages = probability.shape[1]
        total = np.zeros(self.size * languages)
        for rows, marked in by_length(words):
            length = len(marked[0])
            own_language, n = language[rows], counts[rows]
            found = [(s, e, r, p, scaled[p, own_language[r]]) for s, e, r, p in self.matches(marked)]
            ahead = self._sums(length, len(marked), ((s, e, r, q) for s, e, r, _, q in found))
            # from the end: the same sums over the mirrored places
            behind = self._sums(length, len(marked), ((length - e, length - s, r, q) for s, e, r, _, q in sorted(found, key=lambda f: -f[1])))[::-1]
            ahead -= ahead[length]
            for start, end, r, p, q in found:
                weight = np.exp(ahead[start, r] + behind[end, r]) * q * n[r]
                total += np.bincount(p * languages + own_language[r], weight, minlength=len(total))
        return total.reshape(self.size, languages)


def rescale(window: np.ndarray, offset: np.ndarray) -> None:
    """Divide, in place, the sums of a place and of those that it still reaches by the largest of them, where the
    place's own sum is about to leave the range of numbers; ``offset`` takes the logarithm."""
    here = window[0]
    far = (here < LEAST) | (here > MOST)
    if far.any():
        top = np.where(far, window.max(axis=0), 1.0)
        window /= top
        offset += np.log(top)


def by_length(words: list[str], rows_at_once: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and marked words of one length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
        for at in range(0, len(rows), rows_at_once):
            part = rows[at : at + rows_at_once]
            yield part, [MARK + words[r] for r in part]


_LATTICES: dict[str, Lattice] = {}


def lattice(vocabulary: str) -> Lattice:
    if vocabulary not in _LATTICES:
        _LATTICES[vocabulary] = Lattice(vocabulary)
    return _LATTICES[vocabulary]


class Model:
    """Languages and (pieces, languages) probabilities."""

    def __init__(self, languages: list[str], probability: np.ndarray, vocabulary: str):
        self.languages, self.probability, self.vocabulary = languages, probability, vocabulary


def distinct_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of all rows with a language, summed within tasks before the shuffle."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush():
            for language, words in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )
            seen.clear()

        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(language, Counter()).update(words_of(value.as_py()))
                if sum(map(len, seen.values())) > WORDS_HELD:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learn from every row that has a text and a language.

    The driver holds languages × pieces of the vocabulary, whatever the number of texts.
    """
    spark = docs.sparkSession
    words = written(distinct_words(docs, text, lang), "words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    size = lattice(vocabulary).size
    number = {x: k for k, x in enumerate(languages)}
    probability = np.full((size, max(1, len(languages))), 1 / size)
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(probability)

        def step(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = lattice(vocabulary)
            total = np.zeros(shared.value.shape)
            for f in frames:
                total += own.expected(f["word"].tolist(), f["n"].to_numpy(float), f["lang"].map(number).to_numpy(), shared.value)
            piece, language = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": language, "n": total[piece, language]})

        sums = words.mapInPandas(step, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        counts = np.full(probability.shape, PRIOR)
        for r in sums.collect():
            counts[r["piece"], r["language"]] += r["n"]
        probability = counts / counts.sum(axis=0)
    return Model(languages, probability, vocabulary)


class Scorer:
    """Log-likelihoods of distinct words, bounded; starts anew when full."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, lattice(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.values = np.zeros((WORDS_HELD, len(self.model.languages)))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words.difference(self.row)]
        if len(self.row) + len(fresh) > len(self.values):
            self.clear()
            fresh = list(words)
            if len(fresh) > len(self.values):
                self.values = np.zeros((len(fresh), len(self.model.languages)))
        if fresh:
            at = len(self.row)
            self.values[at : at + len(fresh)] = self.lattice.log_likelihood(fresh, self.model.probability)
            self.row.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        return self.values[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all, if not given), lang_pred and score: the likeliest language and its posterior under
    equal priors.

    A null text, a text without a letter, or a model that saw no language gives ``und`` with score 0. Ties go to
    the first language by name. Equal and null keys stay rows of their own. Columns that are named like the new
    ones are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        languages = shared.value.languages
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [words_of(t) if t else [] for t in part.column(len(keep)).to_pylist()]
                scorer.learn(set().union(*texts))
                names, scores = [], []
                for words in texts:
                    if not words or not languages:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = scorer.total(words)
                    best = int(np.argmax(total))
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                columns = [*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4) -> DataFrame:
    """(key, held_out, lang_pred, score): learned from the documents that are not held out, predicted for all."""
    model = fit(docs.where(~held_out(key, modulus)), vocabulary, text, lang)
    return predict(docs, model, text, [key]).select(key, held_out(key, modulus).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float = 0.5, vocabulary: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4) -> DataFrame:
    """The documents, all columns, whose language is one of those learned, with a score of at least ``least``."""
    model = fit(docs.where(~held_out(key, modulus)), vocabulary, text, lang)

    def work(rows: DataFrame) -> DataFrame:
        marked = predict(rows, model, text)
        return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).drop("lang_pred", "score")

    # the prediction's columns may not hide the documents' own of that name
    return shielded(docs, {"score", "lang_pred", "_text"}, work)
