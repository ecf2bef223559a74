"""Language-model scores by logistic context mixing.

A text is its words, then an end; a word is its bytes, then a mark; a byte is eight binary decisions. Several
predictors guess every bit: one knows the whole word so far, others the last one to four bytes, hashed into tables.
Each turns its counts into a stretched probability; a mixer adds them with weights that a gate selects (by the bit's
place and by how often the word so far was seen), and an adaptive table refines the outcome. Weights and refinement
are learned online, bit after bit, each from counts without the very occurrence that is predicted.

These predictors see the word alone, so every distinct word of the corpus is scored once. The distinct words are
dealt out by ranges, and within a range all words that begin alike stand together: a binary decision is a cut of such
a run, its counts are sums over the two parts, and a decision shared by many words is made once. Ranges share
decisions only on the paths of the words that part them; those counts are summed over the ranges first.

The word before is a context as well, and nothing of it is hashed away: what follows it is counted in all training
documents, pair by pair, and mixed with the word's own probability by a weight that a gate selects (by how often the
word before was seen). These weights maximise the likelihood of the training documents, each occurrence predicted from
the counts of the others. Both parts sum to one over all words, so the mixture does.

Documents are read once and kept as chunks: the chunk's distinct words and a number for every token. Chunks ask for
what they need, one line for every part of the words or of the pairs, and are answered in the order they asked. A pair
occurs once in a chunk's question however common it is, and only counts of words and pairs meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import freed, held_out, shipped, written

#: Slots of the tables for contexts of one to four bytes.
SLOTS = (1 << 16, 1 << 16, 1 << 18, 1 << 19)
INPUTS = len(SLOTS) + 2
#: Gates: place of the bit in its byte, and the size of the count of the word so far.
SIZES = 16
GATES = 8 * SIZES
RATE, AT_ONCE = 0.02, 2048
#: The refinement: cells over the stretched probability, its range, and the weight of the mixer's own guess in a cell.
CELLS, REACH, FAITH = 33, 12.0, 2.0
LEAST = 1e-7
#: Gates of the word before (by the size of its count), and steps of the ratio of a pair's share to its word's probability.
BEFORE, STEPS, LOW, HIGH = 24, 20, -4, 9
#: Tokens of a chunk of documents, and of a part of the pairs; words of a part that answers; words of chunks added up at once.
TOKENS, PAIRS, WORDS, COUNTED = 1_000_000, 2_000_000, 100_000, 500_000
#: A word is scored in pieces of so many bytes; distinct words of one range; words sent to every worker.
PIECE, RANGE, FREQUENT = 64, 300_000, 200_000
WORD_MARK, PIECE_MARK, END = b"\x20", b"\x0b", b"\n"
#: Stands before the first token of a text.
START = np.uint64(0x2545F4914F6CDD1D)


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A to Z only) as UTF-8, then the end. Bytes are split at the six blanks of ASCII only."""
    return [*text.encode().lower().split(), END]


def identity(word: bytes) -> int:
    """64 bits that stand for a word in joins."""
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >= 1 << 63 else x


def pieces(word: bytes) -> list[bytes]:
    cut = [word[k : k + PIECE] for k in range(0, len(word), PIECE)]
    return [*(c + PIECE_MARK for c in cut[:-1]), cut[-1] + WORD_MARK]


# one range of words -------------------------------------------------------------------------------------


class Walk:
    """The binary decisions of sorted words, level by level."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        """``words`` ascending, each ended by a mark that occurs nowhere else in it."""
        self.counts = counts
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.lengths.max())
        self.bytes = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        differ = self.bytes[1:] != self.bytes[:-1]
        at = np.argmax(differ, axis=1)
        rows = np.arange(len(words) - 1)
        apart = self.bytes[1:][rows, at] ^ self.bytes[:-1][rows, at]
        common = 8 * at + 7 - np.floor(np.log2(np.maximum(apart, 1))).astype(np.int64)
        # equal words share every decision
        self.common = np.concatenate([[-1], np.where(differ.any(axis=1), common, 8 * width + 1)])

    def levels(self) -> Iterator[tuple]:
        """(byte, bit, active words, starts of the decisions within them, bits of the words)."""
        for byte in range(self.bytes.shape[1]):
            active = np.flatnonzero(self.lengths > byte)
            column, common = self.bytes[active, byte], self.common[active]
            for bit in range(8):
                yield byte, bit, active, np.flatnonzero(common < 8 * byte + bit), (column >> (7 - bit)) & 1


def _slots(rows: np.ndarray, byte: int, bit: int) -> list[np.ndarray]:
    """Slots of the decisions whose words are ``rows`` (of bytes), for every context."""
    node = (np.uint64(1 << bit) | (rows[:, byte] >> np.uint8(8 - bit)).astype(np.uint64)) if bit else np.ones(len(rows), np.uint64)
    out, context = [], np.zeros(len(rows), np.uint64)
    for k, size in enumerate(SLOTS, 1):
        # before the word lies nothing, which is no byte
        last = rows[:, byte - k].astype(np.uint64) + np.uint64(1) if byte >= k else np.zeros(len(rows), np.uint64)
        context = (context * np.uint64(0x9E3779B97F4A7C15)) ^ (last * np.uint64(0xD6E8FEB86659FD93))
        h = (context ^ (node * np.uint64(0xA24BAED4963EE407))) * np.uint64(0x9FB21C651E98DF25)
        out.append((h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64))
    return out


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _guess(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.02) / (n0 + 0.02)) * (1 - 1 / (1.5 + n0 + n1))


def _inputs(n0: np.ndarray, n1: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(decisions, inputs) stretched guesses, the last a constant."""
    x = np.empty((len(n0), INPUTS))
    x[:, 0] = _guess(n0, n1)
    for k, (a, b) in enumerate(low, 1):
        x[:, k] = _guess(a, b)
    x[:, -1] = 0.3
    return x


def _gate(bit: int, n: np.ndarray) -> np.ndarray:
    return bit * SIZES + np.minimum(np.log2(n + 1).astype(np.int64), SIZES - 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(stretch(p), -REACH, REACH) + REACH) * ((CELLS - 1) / (2 * REACH))).astype(np.int64)


class Mixer:
    """Weights by gate, and the refinement's sums by gate and cell."""

    def __init__(self):
        # at the start the word so far is believed, and the last bytes a little
        self.weights = np.full((GATES, INPUTS), 0.1)
        self.weights[:, 0] = 0.8
        self.seen = np.zeros(GATES)
        self.ones = np.zeros((GATES, CELLS))
        self.all = np.zeros((GATES, CELLS))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(squash((x * self.weights[gate]).sum(axis=1)), LEAST, 1 - LEAST)

    def refined(self, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        cell = _cell(p)
        own = (self.ones[gate, cell] + FAITH * p) / (self.all[gate, cell] + FAITH)
        return np.clip((p + own) / 2, LEAST, 1 - LEAST)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """Predict, then update, a few decisions at a time; a gate's step is the mean error of its occurrences."""
        for at in range(0, len(x), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            a, g, y, w = x[part], gate[part], bit[part], weight[part]
            p = self.mixed(a, g)
            total = np.bincount(g, w, minlength=GATES)
            on = total > 0
            error = (y - p) * w
            for k in range(INPUTS):
                step = np.bincount(g, error * a[:, k], minlength=GATES)
                self.weights[on, k] += RATE * step[on] / total[on]
            self.seen += total
            key = g * CELLS + _cell(p)
            self.all += np.bincount(key, w, minlength=GATES * CELLS).reshape(GATES, CELLS)
            self.ones += np.bincount(key, w * y, minlength=GATES * CELLS).reshape(GATES, CELLS)


def _decisions(walk: Walk, shared: dict, byte: int, bit: int, active: np.ndarray, starts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n0, n1) of a level's decisions; those on a path between ranges have their sums over all ranges."""
    n = walk.counts[active]
    n1 = np.add.reduceat(n * bits, starts)
    n0 = np.add.reduceat(n, starts) - n1
    for place in {0, len(starts) - 1}:
        key = _prefix(walk.bytes[active[starts[place]]], 8 * byte + bit)
        if key in shared:
            n0[place], n1[place] = shared[key]
    return n0, n1


def _prefix(row: np.ndarray, bits: int) -> tuple[int, bytes]:
    whole, part = divmod(bits, 8)
    head = row[: whole + bool(part)].tobytes()
    return (bits, head[:-1] + bytes([head[-1] >> (8 - part) << (8 - part)])) if part else (bits, head)


def paths(words: list[bytes], counts: np.ndarray) -> dict:
    """Counts of the decisions on the first and the last word's paths: all that other ranges can share."""
    walk = Walk(words, counts)
    out = {}
    for byte, bit, active, starts, bits in walk.levels():
        if not len(active):
            break
        n = walk.counts[active]
        for a, b in {(0, starts[1] if len(starts) > 1 else len(n)), (starts[-1], len(n))}:
            n1 = float((n[a:b] * bits[a:b]).sum())
            out[_prefix(walk.bytes[active[a]], 8 * byte + bit)] = (float(n[a:b].sum()) - n1, n1)
    return out


def context_counts(words: list[bytes], counts: np.ndarray, tables: list[np.ndarray]) -> None:
    """Adds every decision's counts to the tables of (2, slots)."""
    walk = Walk(words, counts)
    for byte, bit, active, starts, bits in walk.levels():
        if not len(active):
            break
        n = walk.counts[active]
        n1 = np.add.reduceat(n * bits, starts)
        n0 = np.add.reduceat(n, starts) - n1
        for table, slot in zip(tables, _slots(walk.bytes[active[starts]], byte, bit), strict=True):
            np.add.at(table[0], slot, n0)
            np.add.at(table[1], slot, n1)


def train(words: list[bytes], counts: np.ndarray, tables: list[np.ndarray], shared: dict, mixer: Mixer) -> None:
    """Online learning over one range; every occurrence is predicted from the counts of the others."""
    walk = Walk(words, counts)
    for byte, bit, active, starts, bits in walk.levels():
        if not len(active):
            break
        n0, n1 = _decisions(walk, shared, byte, bit, active, starts, bits)
        slots = _slots(walk.bytes[active[starts]], byte, bit)
        low = [(t[0][s].astype(float), t[1][s].astype(float)) for t, s in zip(tables, slots, strict=True)]
        # both outcomes of a decision, one after the other
        value = np.tile([0.0, 1.0], len(n0))
        n = np.stack([n0, n1], axis=1).ravel()
        on = n > 0
        value, n, own = value[on], n[on], np.repeat(np.arange(len(n0)), 2)[on]
        less = (1 - value, value)
        others = [(np.maximum(a[own] - less[0], 0), np.maximum(b[own] - less[1], 0)) for a, b in low]
        x = _inputs(n0[own] - less[0], n1[own] - less[1], others)
        mixer.learn(x, _gate(bit, n0[own] + n1[own] - 1), value, n)


def score(words: list[bytes], counts: np.ndarray, tables: list[np.ndarray], shared: dict, mixer: Mixer) -> np.ndarray:
    """log10 probabilities of the words of one range."""
    walk = Walk(words, counts)
    total = np.zeros(len(words))
    for byte, bit, active, starts, bits in walk.levels():
        if not len(active):
            break
        n0, n1 = _decisions(walk, shared, byte, bit, active, starts, bits)
        slots = _slots(walk.bytes[active[starts]], byte, bit)
        x = _inputs(n0, n1, [(t[0][s], t[1][s]) for t, s in zip(tables, slots, strict=True)])
        gate = _gate(bit, n0 + n1)
        p = mixer.refined(mixer.mixed(x, gate), gate)
        one, zero = np.log10(p), np.log10(1 - p)
        each = np.diff(np.append(starts, len(active)))
        total[active] += np.where(bits == 1, np.repeat(one, each), np.repeat(zero, each))
    return total


# Spark --------------------------------------------------------------------------------------------------


CHUNK = "chunk long, keys array<{kind}>, held array<boolean>, lengths binary, codes binary, distinct long, letters long, words binary, n binary"


def squeezed(x: np.ndarray) -> bytes:
    """An array's bytes, place by place, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def spread(raw: bytes, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def joined(words: Iterable[bytes]) -> tuple[int, bytes]:
    """(bytes, words in one piece, compressed); no word holds a blank."""
    whole = b" ".join(words)
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def parted(letters: int, raw: bytes) -> list[bytes]:
    return pa.decompress(raw, decompressed_size=letters, codec="zstd", asbytes=True).split(b" ")


def chunked(docs: DataFrame, key: str, text: str, modulus: int) -> DataFrame:
    """Documents, many to a line: their keys and folds, how many tokens each has, the tokens as numbers of the chunk's
    distinct words, and how often its training documents have each word."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(key, modulus).alias("held"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        place: dict[bytes, int] = {}
        keys, held, lengths, codes = [], [], [], []

        def line() -> pa.RecordBatch:
            nonlocal number
            every, sizes, fold = np.concatenate(codes), np.concatenate(lengths), np.concatenate(held)
            n = np.bincount(every[~np.repeat(fold, sizes)], minlength=len(place)).astype(np.int64)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            letters, words = joined(place)
            fields = [pa.array([number]), whole(pa.concat_arrays(keys)), whole(pa.array(fold)), pa.array([sizes.tobytes()], pa.binary()), pa.array([squeezed(every)], pa.binary())]
            fields += [pa.array([len(place)]), pa.array([letters]), pa.array([words], pa.binary()), pa.array([squeezed(n)], pa.binary())]
            number += 1
            for x in (place, keys, held, lengths, codes):
                x.clear()
            return pa.RecordBatch.from_arrays(fields, names=["chunk", "keys", "held", "lengths", "codes", "distinct", "letters", "words", "n"])

        count = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = [tokens(t) for t in part.column(1).to_pylist()]
                flat = list(chain.from_iterable(lists))
                for w in set(flat).difference(place):
                    place[w] = len(place)
                codes.append(np.fromiter(map(place.__getitem__, flat), np.uint32, len(flat)))
                lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                keys.append(part.column(0))
                held.append(np.array(part.column(2).to_pylist(), bool))
                count += len(flat)
                if count >= TOKENS:
                    yield line()
                    count = 0
        if count:
            yield line()

    return rows.mapInArrow(run, CHUNK.format(kind=kind))


class Chunk:
    """One line of :func:`chunked`, opened; columns that a step leaves out are not to be asked for."""

    def __init__(self, row: dict):
        self.row = row
        self.words = parted(row["letters"].as_py(), row["words"].as_py())
        self.ids = np.fromiter(map(identity, self.words), np.int64, len(self.words))

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield cls({name: batch.column(name)[k] for name in batch.schema.names})

    @property
    def chunk(self) -> int:
        return self.row["chunk"].as_py()

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.row["lengths"].as_buffer(), np.int64)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.append(0, np.cumsum(self.lengths)[:-1])

    @cached_property
    def codes(self) -> np.ndarray:
        return spread(self.row["codes"].as_py(), np.uint32, int(self.lengths.sum()))

    @cached_property
    def n(self) -> np.ndarray:
        return spread(self.row["n"].as_py(), np.int64, len(self.ids))

    def held(self) -> np.ndarray:
        """For every token, whether its document is held out."""
        return np.repeat(np.array(self.row["held"].as_py(), bool), self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs of a word and the one before, ascending; a token that has it; the place of every token's pair)."""
        x = self.ids.view(np.uint64)[self.codes]
        before = np.empty_like(x)
        before[1:] = x[:-1]
        before[self.starts] = START
        before *= np.uint64(0x9E3779B97F4A7C15)
        before += ((x >> np.uint64(29)) ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        before ^= before >> np.uint64(32)
        before *= np.uint64(0xD6E8FEB86659FD93)
        before ^= before >> np.uint64(32)
        before *= np.uint64(0xA24BAED4963EE407)
        x += before
        del before
        x ^= x >> np.uint64(31)
        return placed(x)


def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; where each occurs; the place of every value). Sorted with their own numbers in the low
    bits, which is much faster than sorting by number; values that agree in all other bits and do not come out in order
    are sorted in full."""
    low = np.uint64((1 << len(x).bit_length()) - 1)
    order = x & ~low
    order |= np.arange(len(x), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    there = x[order]
    if (there[1:] < there[:-1]).any():
        return np.unique(x, return_index=True, return_inverse=True)
    new = np.append(True, there[1:] != there[:-1])
    place = np.empty(len(x), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return there[new], order[new], place


def word_counts(stored: DataFrame) -> DataFrame:
    """(id, word, n): every distinct token of all documents and how often training documents have it."""
    parts = (stored.agg(F.sum("distinct").alias("n")).first()["n"] or 0) // COUNTED + 1

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in Chunk.of(batches):
            part = c.ids % parts
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            rows = np.split(order, starts[1:])
            blobs = [joined(map(c.words.__getitem__, r.tolist())) for r in rows]
            fields = [pa.array(own, pa.int32()), pa.array([len(r) for r in rows], pa.int64()), pa.array([b[0] for b in blobs], pa.int64())]
            fields += [pa.array([b[1] for b in blobs], pa.binary()), pa.array([squeezed(c.n[r]) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, names=["part", "m", "letters", "words", "n"])

    def add(told: pa.Table) -> pa.Table:
        words = chain.from_iterable(parted(*x) for x in zip(told["letters"].to_pylist(), told["words"].to_pylist(), strict=True))
        n = np.concatenate([spread(x, np.int64, m) for x, m in zip(told["n"].to_pylist(), told["m"].to_pylist(), strict=True)])
        sums = pa.table({"word": pa.array(words, pa.binary()), "n": n}).group_by("word").aggregate([("n", "sum")])
        word = sums["word"].combine_chunks()
        return pa.table({"id": pa.array(map(identity, word.to_pylist()), pa.int64()), "word": word, "n": sums["n_sum"]})

    told = stored.select("distinct", "letters", "words", "n").mapInArrow(tell, "part int, m long, letters long, words binary, n binary")
    return told.groupBy("part").applyInArrow(add, "id long, word binary, n long")


ANSWER = "chunk long, pair boolean, part int, a binary, b binary"


def _answer(chunk: list[int], pair: bool, part: int, a: list[bytes], b: list[bytes] | None = None) -> pa.Table:
    m = len(chunk)
    fields = [pa.array(chunk, pa.int64()), pa.array([pair] * m, pa.bool_()), pa.array([part] * m, pa.int32()), pa.array(a, pa.binary()), pa.array(b or [None] * m, pa.binary())]
    return pa.table(fields, names=["chunk", "pair", "part", "a", "b"])


def word_answers(stored: DataFrame, table: DataFrame, parts: int, known: Callable) -> DataFrame:
    """For every chunk and part of the words: count and score of the chunk's words that are not ``known``, in their order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in Chunk.of(batches):
            ids = c.ids[known(c.ids) < 0]
            part = ids % parts
            own = np.unique(part).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.chunk] * len(own), pa.int64()), pa.array(own, pa.int32()), pa.array([ids[part == p].tobytes() for p in own], pa.binary())], names=["chunk", "part", "ids"]
            )

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _answer([], False, 0, [])
        told = told.sort_by("id")
        ids, n, value = (told[c].to_numpy() for c in ("id", "n", "score"))
        at = [np.searchsorted(ids, np.frombuffer(raw.as_buffer(), np.int64)) for raw in asked["ids"]]
        return _answer(asked["chunk"].to_pylist(), False, asked["part"][0].as_py(), [squeezed(n[k]) for k in at], [squeezed(value[k]) for k in at])

    asked = stored.select("chunk", "letters", "words").mapInArrow(ask, "chunk long, part int, ids binary")
    told = table.select(F.pmod("id", F.lit(parts)).cast("int").alias("part"), "id", "n", "score")
    return asked.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer, ANSWER)


def pair_answers(stored: DataFrame, bits: int) -> DataFrame:
    """For every chunk and part of the pairs (by their first ``bits``): how often training documents have each pair."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in Chunk.of(batches):
            pairs, _, place = c.pairs()
            n = np.bincount(place[~c.held()], minlength=len(pairs)).astype(np.uint32)
            part = (pairs >> np.uint64(64 - bits)).astype(np.int32)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = [*cuts[1:].tolist(), len(pairs)]
            spans = list(zip(cuts.tolist(), ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.chunk] * len(spans), pa.int64()),
                    pa.array(part[cuts]),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([squeezed(np.diff(pairs[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                    pa.array([squeezed(n[a:b]) for a, b in spans], pa.binary()),
                ],
                names=["chunk", "part", "m", "pairs", "n"],
            )

    def answer(asked: pa.Table) -> pa.Table:
        sizes = asked["m"].to_pylist()
        pairs = np.concatenate([np.cumsum(spread(x.as_py(), np.uint64, m), dtype=np.uint64) for x, m in zip(asked["pairs"], sizes, strict=True)])
        n = np.concatenate([spread(x.as_py(), np.uint32, m) for x, m in zip(asked["n"], sizes, strict=True)])
        distinct, place = np.unique(pairs, return_inverse=True)
        sums = np.bincount(place, n, minlength=len(distinct)).astype(np.int64)[place]
        cuts = np.cumsum(sizes)[:-1]
        return _answer(asked["chunk"].to_pylist(), True, asked["part"][0].as_py(), [squeezed(x) for x in np.split(sums, cuts)])

    rows = stored.select("chunk", "held", "lengths", "codes", "letters", "words")
    return rows.mapInArrow(ask, "chunk long, part int, m long, pairs binary, n binary").groupBy("part").applyInArrow(answer, ANSWER)


def dealt(words: DataFrame, ranges: int, bounds: list[bytes]) -> DataFrame:
    """(ids, pieces, counts): a line for every range of pieces, in ascending order; written once and read by every step."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, dtype=object)
        for batch in batches:
            owner, raw = [], []
            for k, word in enumerate(batch.column(1).to_pylist()):
                own = pieces(word)
                raw += own
                owner += [k] * len(own)
            part = np.searchsorted(cuts, np.array(raw, dtype=object), side="right") if len(cuts) else np.zeros(len(raw))
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(raw, pa.binary()), batch.column(2).take(take), pa.array(np.asarray(part, np.int32))], names=["id", "piece", "n", "part"]
            )

    each = words.select("id", "word", "n").mapInArrow(deal, "id long, piece binary, n long, part int")
    each = each.repartition(ranges, "part").sortWithinPartitions("part", "piece")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.concat_tables(held).combine_chunks()
                held.clear()
                pieces = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.concat_arrays(whole["piece"].chunks))
                ids, n = (pa.array([whole[c].to_numpy().tobytes()], pa.binary()) for c in ("id", "n"))
                yield pa.RecordBatch.from_arrays([ids, pieces, n], names=["ids", "pieces", "n"])

        last = None
        for batch in batches:
            part = batch.column(3).to_numpy()
            for rows in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1) if len(part) else []:
                if part[rows[0]] != last:
                    yield from done()
                    last = part[rows[0]]
                held.append(pa.Table.from_batches([batch.slice(rows[0], len(rows))]))
        yield from done()

    return written(each.mapInArrow(gathered, "ids binary, pieces array<binary>, n binary"), "ranges")


def _by_range(stored: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(ids, pieces, counts)`` over every range; each is one call."""

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, n in zip(*(batch.column(c) for c in ("ids", "pieces", "n")), strict=True):
                yield from run(np.frombuffer(ids.as_buffer(), np.int64), raw.values.to_pylist(), np.frombuffer(n.as_buffer(), np.int64).astype(float)).to_batches()

    return stored.mapInArrow(called, schema)


class Model:
    """What the workers need to score words: tables of contexts, shared decisions, the mixer. Of fixed size but for
    the shared decisions, of which there are a few hundred for every range."""

    def __init__(self, tables: list[np.ndarray], shared: dict, mixer: Mixer, ranges: DataFrame):
        self.tables, self.shared, self.mixer, self.ranges = tables, shared, mixer, ranges


def fit(words: DataFrame, range_words: int = RANGE) -> Model:
    """Learn from stored (id, word, n)."""
    spark = words.sparkSession
    distinct = words.count()
    ranges = max(1, -(-distinct // range_words))
    # words that part the ranges: of a sample of about 64 for every range, every 64th
    sample = words.where(F.pmod(F.xxhash64("id"), F.lit(max(1, distinct // (64 * ranges)))) == 0) if ranges > 1 else words.limit(0)
    drawn = sorted(pieces(bytes(r["word"]))[0] for r in sample.select("word").collect())
    bounds = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []
    stored = dealt(words, ranges, bounds)

    def on_paths(ids: np.ndarray, raw: list[bytes], n: np.ndarray) -> pa.Table:
        found = paths(raw, n)
        keys = list(found)
        return pa.table(
            {
                "bits": pa.array([k[0] for k in keys], pa.int32()),
                "prefix": pa.array([k[1] for k in keys], pa.binary()),
                "n0": pa.array([found[k][0] for k in keys], pa.float64()),
                "n1": pa.array([found[k][1] for k in keys], pa.float64()),
            }
        )

    shared = {}
    if bounds:
        both = _by_range(stored, on_paths, "bits int, prefix binary, n0 double, n1 double")
        sums = both.groupBy("bits", "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("k")).where("k > 1")
        shared = {(r["bits"], bytes(r["prefix"])): (r["n0"], r["n1"]) for r in sums.collect()}

    def in_contexts(ids: np.ndarray, raw: list[bytes], n: np.ndarray) -> pa.Table:
        tables = [np.zeros((2, s)) for s in SLOTS]
        on = np.flatnonzero(n > 0)
        if len(on):
            context_counts([raw[k] for k in on], n[on], tables)
        order, slot = [], []
        for k, t in enumerate(tables):
            used = np.flatnonzero(t.any(axis=0))
            order.append(np.full(len(used), k, np.int32))
            slot.append(used)
        values = np.concatenate([t[:, s] for t, s in zip(tables, slot, strict=True)], axis=1)
        return pa.table({"k": np.concatenate(order), "slot": np.concatenate(slot).astype(np.int32), "n0": values[0], "n1": values[1]})

    sums = _by_range(stored, in_contexts, "k int, slot int, n0 double, n1 double")
    sums = sums.groupBy("k", "slot").agg(F.sum("n0").cast("float").alias("n0"), F.sum("n1").cast("float").alias("n1")).toArrow()
    tables = [np.zeros((2, s), np.float32) for s in SLOTS]
    order, slot = sums["k"].to_numpy(), sums["slot"].to_numpy()
    values = np.stack([sums["n0"].to_numpy(), sums["n1"].to_numpy()])
    for k, table in enumerate(tables):
        table[:, slot[order == k]] = values[:, order == k]
    del sums, values
    known = spark.sparkContext.broadcast((tables, shared))

    def learn(ids: np.ndarray, raw: list[bytes], n: np.ndarray) -> pa.Table:
        mixer = Mixer()
        on = np.flatnonzero(n > 0)
        if len(on):
            train([raw[k] for k in on], n[on], *known.value, mixer)
        values = np.concatenate([mixer.weights * mixer.seen[:, None], mixer.seen[:, None], mixer.ones, mixer.all], axis=1)
        gate, column = np.nonzero(values)
        return pa.table({"gate": gate.astype(np.int32), "at": column.astype(np.int32), "x": values[gate, column]})

    learned = _by_range(stored, learn, "gate int, at int, x double").groupBy("gate", "at").agg(F.sum("x").alias("x"))
    values = np.zeros((GATES, INPUTS + 1 + 2 * CELLS))
    for r in learned.collect():
        values[r["gate"], r["at"]] = r["x"]
    mixer = Mixer()
    mixer.seen = values[:, INPUTS]
    on = mixer.seen > 0
    mixer.weights[on] = values[on, :INPUTS] / mixer.seen[on, None]
    mixer.ones, mixer.all = values[:, INPUTS + 1 : INPUTS + 1 + CELLS], values[:, INPUTS + 1 + CELLS :]
    return Model(tables, shared, mixer, stored)


def word_scores(model: Model) -> DataFrame:
    """(id, n, score): log10 probability of every distinct word."""
    known = model.ranges.sparkSession.sparkContext.broadcast((model.tables, model.shared, model.mixer))

    def run(ids: np.ndarray, raw: list[bytes], n: np.ndarray) -> pa.Table:
        return pa.table({"id": ids, "n": n.astype(np.int64), "score": score(raw, n, *known.value)})

    each = _by_range(model.ranges, run, "id long, n long, score double")
    return each.groupBy("id").agg(F.max("n").alias("n"), F.sum("score").alias("score"))


def gate_before(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), BEFORE - 1)


def trust(counts: np.ndarray) -> np.ndarray:
    """The weight of the word before for every gate, from how often each ratio occurred: (gates, ratios), the first ratio 0."""
    ratio = np.append(0.0, 10 ** (LOW + (np.arange(counts.shape[1] - 1) + 0.5) / STEPS)) - 1
    low, high = np.zeros(len(counts)), np.full(len(counts), 1 - 1e-9)
    for _ in range(60):  # the likelihood is concave: halve by the sign of its slope
        half = (low + high) / 2
        up = (counts * (ratio / (1 + half[:, None] * ratio))).sum(axis=1) > 0
        low, high = np.where(up, half, low), np.where(up, high, half)
    return np.where(counts.sum(axis=1) > 0, low, 0.0)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, range_words: int = RANGE, frequent: int = FREQUENT) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): one row per document.

    A null text is an empty document: its end is its only token. Repeated rows and null keys stay rows of their
    own. An empty table gives no rows; without training documents every word is new. ``n_bytes`` counts the words'
    bytes and a mark for every token; ``bits_per_byte`` is -score in bits over it. Other columns are left out.
    """
    spark = docs.sparkSession
    shipped(spark)
    kind = docs.schema[key].dataType.simpleString()
    stored = written(chunked(docs, key, text, modulus), "chunks")
    words = written(word_counts(stored), "counts")
    ends = F.sum(F.when(F.col("id") == identity(END), F.col("n")))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v"), F.count(F.lit(1)).alias("all"), F.coalesce(ends, F.lit(0)).alias("docs")).first()
    total, floor, training = sums["n"], math.log10(sums["n"] + sums["v"] + 1), sums["docs"]
    if sums["all"]:
        model = fit(words, range_words)
        table = written(word_scores(model), "scores")
        freed(words)
        freed(model.ranges)
    else:
        table = words.select("id", "n", F.lit(0.0).alias("score"))
    top = table.orderBy(F.desc("n"), "id").limit(frequent).select("id", "n", "score").sort("id").toArrow()
    shared = spark.sparkContext.broadcast((top["id"].to_numpy(), top["n"].to_numpy(), top["score"].to_numpy()))

    def known(ids: np.ndarray) -> np.ndarray:
        """Places among the frequent words, -1 for others."""
        own = shared.value[0]
        if not len(own):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        return np.where(own[at] == ids, at, -1)

    bits, others = max(1, (total // PAIRS).bit_length()), sums["all"] // WORDS + 1
    answers = written(word_answers(stored, table, others, known).unionByName(pair_answers(stored, bits)), "answers")
    if sums["all"]:
        freed(table)
    both = stored.drop("n").groupBy("chunk").cogroup(answers.groupBy("chunk"))

    def opened(left: pa.Table, right: pa.Table) -> tuple:
        """The chunk and its words' counts; the place of every token's pair, and for every pair: how often it occurs and
        the word before it, and its word's score."""
        c = next(Chunk.of(left.to_batches()))
        at = known(c.ids)
        n, value = np.zeros(len(at), np.int64), np.zeros(len(at))
        n[at >= 0], value[at >= 0] = shared.value[1][at[at >= 0]], shared.value[2][at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        owner = c.ids[rest] % others
        pairs, first, place = c.pairs()
        count, cuts = np.zeros(len(pairs), np.int64), (pairs >> np.uint64(64 - bits)).astype(np.int64)
        for r in right.to_pylist():
            if r["pair"]:
                a, b = np.searchsorted(cuts, [r["part"], r["part"] + 1])
                count[a:b] = spread(r["a"], np.int64, b - a)
            else:
                here = rest[owner == r["part"]]
                n[here], value[here] = spread(r["a"], np.int64, len(here)), spread(r["b"], np.float64, len(here))
        begins = np.zeros(len(c.codes), bool)
        begins[c.starts] = True
        before = np.where(begins[first], training, n[c.codes[first - 1]])
        return c, n, place, count, before, value[c.codes[first]]

    def ratios(left: pa.Table, right: pa.Table) -> pa.Table:
        """How often each ratio occurs in training documents by gate, the predicted occurrence left out."""
        out = np.zeros((BEFORE, 1 + STEPS * (HIGH - LOW)))
        if left.num_rows:
            c, _, place, count, before, own = opened(left, right)
            taught = np.bincount(place[~c.held()], minlength=len(count))
            on = np.flatnonzero((taught > 0) & (before > 1))
            count, before, own = count[on] - 1, before[on] - 1, own[on]
            step = np.zeros(len(on), np.int64)
            some = count > 0
            step[some] = 1 + np.clip((np.log10(count[some] / before[some]) - own[some] - LOW) * STEPS, 0, out.shape[1] - 2).astype(np.int64)
            out = np.bincount(gate_before(before) * out.shape[1] + step, taught[on], minlength=out.size).reshape(out.shape)
        gate, at = np.nonzero(out)
        return pa.table({"gate": pa.array(gate, pa.int32()), "at": pa.array(at, pa.int32()), "x": pa.array(out[gate, at].astype(np.int64))})

    counts = np.zeros((BEFORE, 1 + STEPS * (HIGH - LOW)))
    for r in both.applyInArrow(ratios, "gate int, at int, x long").groupBy("gate", "at").agg(F.sum("x").alias("x")).collect():
        counts[r["gate"], r["at"]] = r["x"]
    weight = trust(counts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c, n, place, count, before, own = opened(left, right)
        w = np.where(before > 0, weight[gate_before(before)], 0.0)
        # in logarithms: a long word's own probability may be below the least double
        token = own + np.log10(1 - w)
        on = np.flatnonzero((count > 0) & (w > 0))
        token[on] = np.logaddexp(token[on] * math.log(10), np.log(w[on] * count[on] / before[on])) / math.log(10)
        each = lambda x: np.add.reduceat(x, c.starts)
        score, size = each(token[place]), each(np.fromiter(map(len, c.words), np.int64, len(c.words))[c.codes]) + c.lengths - 1
        seen, base = each((n > 0).astype(np.int64)[c.codes]), each((np.log10(n + 1.0) - floor)[c.codes])
        fields = [c.row["keys"].values, c.row["held"].values, *map(pa.array, (c.lengths, seen, np.full(len(size), total), base, score, size, -score * math.log2(10) / size))]
        return pa.table(fields, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return both.applyInArrow(run, schema).withColumnRenamed("key", key)
