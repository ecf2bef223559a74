"""Best-fit packing of tokenised documents by bin completion.

Tokens: ids of a text are the ids of its words (the vocabulary drops white space and never joins across it), so
each worker tokenises a distinct word once. Packing: pieces of equal length are alike, so the problem is a
histogram with at most ``capacity`` lines. Around the largest piece left, undominated fillings are enumerated
(larger pieces first, the first one is the best-fit filling and the incumbent; branches whose remaining pieces
cannot beat the incumbent's waste are cut), and the best is used as often as the counts allow. The last pieces
are searched with branch and bound over whole packings. The plan, a few lines per length, is then dealt to the
pieces by their rank within their length; no piece passes the driver.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import vocabulary_path, written

CAPACITY = 4096
#: Fillings looked at around one largest piece, and whole packings' nodes for the last pieces.
FILLING_NODES, PACKING_NODES, LAST_PIECES = 3_000, 20_000, 48


# tokens -------------------------------------------------------------------------------------------------

WORDS_HELD = 600_000
#: Parts in one text for the tokenizer: long texts take longer a part.
TOGETHER = 64
#: What the tokenizer splits a normalised word into, and the characters for which that split and the lower-casing
#: here are the same as its own (no character composes, and all keep their length); other words are left to it.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")


class WordIds:
    """Distinct words, and distinct parts of words, with their packed ids; bounded, starts anew when full."""

    def __init__(self, vocabulary: str, entries: int = WORDS_HELD):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        size = self.tokenizer.get_vocab_size()
        # the last id of a part has the mark of a word's end
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.entries = entries
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> list[bytes]:
        # only white space that every Unicode version calls white space splits; the rest is the tokenizer's
        split = []
        for text in texts:
            for c in "\t\n\r\x0b\x0c":
                if c in text:
                    text = text.replace(c, " ")
            split.append(text.split(" "))
        self._learn(set().union(*split))
        return [b"".join(map(self.words.__getitem__, words)) for words in split]

    def _learn(self, words: set[str]) -> None:
        fresh = words.difference(self.words)
        if len(self.words) + len(fresh) > self.entries:
            self.words = {"": b""}
            fresh = words - {""}
        parted = {w: _PARTS.findall(w.lower()) if _PLAIN.fullmatch(w) and "<|" not in w else None for w in fresh}
        needed = set().union(*(p for p in parted.values() if p is not None))
        if len(self.parts) + len(needed) > self.entries:
            self.parts.clear()
        self._encode(list(needed.difference(self.parts)))
        for w, p in parted.items():
            self.words[w] = self._whole(w) if p is None else b"".join(map(self.parts.__getitem__, p))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, parts: list[str]) -> None:
        """Plain letters go straight to the tokenizer's model, the others many at once."""
        tokenize, letters = self.tokenizer.model.tokenize, [p for p in parts if p.isascii() and p.isalpha()]
        for p in letters:
            self.parts[p] = np.array([t.id for t in tokenize(p)], "<u4").tobytes()
        parts = list(set(parts).difference(letters))
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        encoded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                self.parts.update((p, self._whole(p)) for p in group)
                continue
            flat, at = ids.tobytes(), 0
            for p, cut in zip(group, (4 * cuts).tolist(), strict=True):
                self.parts[p] = flat[at:cut]
                at = cut


_WORDS: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    if vocabulary not in _WORDS:
        _WORDS[vocabulary] = WordIds(vocabulary)
    return _WORDS[vocabulary]


def tokenised(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = False
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids], task, nth) of every document's pieces.

    A document is its text's ids, then ``end``; only longer ones are cut, every ``capacity`` ids. ``task`` and
    ``nth`` number the pieces of one length within the task that made them. Null texts count as empty; equal and
    null keys stay documents of their own.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] * ids), "task", "nth"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] * ids), pa.int32(), pa.int64()]
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * ids + "task int, nth long"
    tail, width = end.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task, seen = word_ids(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bounds what is held at once
                part = batch.slice(start, 256)
                owner, out = [], []
                for row, found in enumerate(table.of(part.column(1).to_pylist())):
                    whole = found + tail
                    for k, at in enumerate(range(0, len(whole), width)):
                        own = whole[at : at + width]
                        n = len(own) // 4
                        owner.append(row)
                        out.append((k, at // 4, n, zlib.crc32(own), *([own] * ids), task, seen[n]))
                        seen[n] += 1
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *columns], names=names)

    return rows.mapInArrow(run, schema)


# the plan over the histogram ----------------------------------------------------------------------------


def best_filling(room: int, counts: dict[int, int], lengths: list[int], nodes: int = FILLING_NODES) -> list[int]:
    """The filling of ``room`` with least waste, larger pieces first; ``lengths`` ascending, all with a count.

    One step takes a length as often as it fits, and less often on the way back, so depth and nodes count lengths
    and not pieces. The nodes end the search beyond the first filling only, which is always complete.
    """
    # what all pieces of lengths[:i] hold together; beyond the list they fill the room
    below = [0]
    for length in lengths:
        if below[-1] >= room:
            break
        below.append(below[-1] + length * counts[length])
    best: list[tuple[int, int]] = []
    best_waste = room
    chosen: list[tuple[int, int]] = []  # (place in lengths, times)
    rest, top, first = room, len(lengths), True
    while True:
        top = bisect.bisect_right(lengths, rest, 0, top)
        if top and (first or (nodes > 0 and rest - (below[top] if top < len(below) else room) < best_waste)):
            top -= 1
            length = lengths[top]
            times = min(counts[length], rest // length)
            if times == 1 and not first and lengths[0] > rest - length >= best_waste:
                continue  # nothing fits beside this one, and it wastes no less than the incumbent
            chosen.append((top, times))
            rest -= times * length
            nodes -= 1
            continue
        first = False
        if rest < best_waste:
            best, best_waste = list(chosen), rest
        if not chosen or not best_waste or nodes <= 0:
            return [lengths[at] for at, times in best for _ in range(times)]
        top, times = chosen.pop()
        rest += lengths[top]
        if times > 1:
            chosen.append((top, times - 1))


def lower_bound(pieces: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces that cannot share."""
    total = sum(k * n for k, n in pieces.items())
    bound = -(-total // capacity)
    for small in sorted({k for k in pieces if 2 * k <= capacity} | {1}):
        alone = sum(n for k, n in pieces.items() if k > capacity - small)
        big = {k: n for k, n in pieces.items() if capacity - small >= k and 2 * k > capacity}
        half = sum(n * k for k, n in pieces.items() if small <= k <= capacity // 2)
        room = sum((capacity - k) * n for k, n in big.items())
        bound = max(bound, alone + sum(big.values()) + max(0, -(-(half - room) // capacity)))
    return bound


def best_fit(pieces: list[int], capacity: int) -> list[list[int]]:
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    for p in sorted(pieces, reverse=True):
        at = bisect.bisect_left(rooms, (p, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(p)
        else:
            room, b = capacity, len(bins)
            bins.append([p])
        bisect.insort(rooms, (room - p, b))
    return bins


def fillings(room: int, pieces: list[int], limit: int = 64) -> list[tuple[int, ...]]:
    """Maximal fillings of ``room`` (no further piece fits), least waste first, larger pieces first."""
    counts = Counter(pieces)
    lengths = sorted(counts, reverse=True)
    found: list[tuple[int, tuple[int, ...]]] = []

    def go(rest: int, at: int, chosen: tuple[int, ...]) -> None:
        if len(found) >= 8 * limit:
            return
        fits = False
        for k in range(at, len(lengths)):
            length = lengths[k]
            if length <= rest and counts[length]:
                fits = True
                counts[length] -= 1
                go(rest - length, k, (*chosen, length))
                counts[length] += 1
        # a piece before ``at`` that still fits makes this filling dominated
        if not fits and not any(counts[x] and x <= rest for x in lengths[:at]):
            found.append((rest, chosen))

    go(room, 0, ())
    return [x for _, x in sorted(found, key=lambda f: (f[0], tuple(-p for p in f[1])))[:limit]]


def search(pieces: list[int], capacity: int, nodes: int = PACKING_NODES) -> list[list[int]]:
    """Branch and bound over whole packings; the best-fit packing is the first incumbent."""
    best = best_fit(pieces, capacity)
    bound = lower_bound(Counter(pieces), capacity)
    total = sum(pieces)
    left = nodes

    def go(rest: list[int], bins: list[list[int]], waste: int) -> bool:
        nonlocal best, left
        if not rest:
            if len(bins) < len(best):
                best = list(bins)
            return len(best) <= bound
        left -= 1
        if left <= 0:
            return True
        # one bin less than the incumbent leaves so much room to waste
        if waste > (len(best) - 1) * capacity - total:
            return False
        if len(bins) + lower_bound(Counter(rest), capacity) >= len(best):
            return False
        first, others = rest[0], rest[1:]
        for filling in fillings(capacity - first, others):
            after = list(others)
            for p in filling:
                after.remove(p)
            if go(after, [*bins, [first, *filling]], waste + capacity - first - sum(filling)):
                return True
        return False

    if len(best) > bound:
        go(sorted(pieces, reverse=True), [], 0)
    return best


def decreasing(pieces: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence): best fit decreasing over a histogram, sequences of like content together.

    Pieces of one length go to the fullest sequences that hold them, each as often as it can; so a length adds a few
    kinds of sequences, however many pieces it has.
    """
    kinds: list[tuple[int, int, list[int]]] = []  # (room, times, lengths), by room
    for length in sorted(pieces, reverse=True):
        left, after = pieces[length], []
        at = bisect.bisect_left(kinds, (length,))
        kept, open_kinds = kinds[:at], kinds[at:]
        for i, (room, times, filling) in enumerate(open_kinds):
            if not left:
                after += open_kinds[i:]
                break
            each = room // length
            full = min(times, left // each)
            if full:
                after.append((room - each * length, full, filling + [length] * each))
                left -= full * each
            if full < times and 0 < left < each:
                after.append((room - left * length, 1, filling + [length] * left))
                left, full = 0, full + 1
            if full < times:
                after.append((room, times - full, filling))
        each = capacity // length
        if left >= each:
            after.append((capacity - each * length, left // each, [length] * each))
        if left % each:
            after.append((capacity - left % each * length, 1, [length] * (left % each)))
        kinds = sorted(kept + after, key=lambda k: k[:2])
    return [(times, filling) for _, times, filling in kinds]


def plan(pieces: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence) for a histogram of lengths: the completed bins, or best fit decreasing over
    the whole histogram where that needs fewer."""
    completed = completion(pieces, capacity)
    if sum(times for times, _ in completed) <= lower_bound({k: n for k, n in pieces.items() if n > 0}, capacity):
        return completed
    return min(completed, decreasing({k: n for k, n in pieces.items() if n > 0}, capacity), key=lambda p: sum(times for times, _ in p))


def completion(pieces: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bin completion around the largest piece left, again and again, and a search over the last pieces."""
    counts = {k: n for k, n in pieces.items() if n > 0}
    lengths = sorted(counts)
    total = sum(counts.values())
    patterns: list[tuple[int, list[int]]] = []
    while total > LAST_PIECES:
        largest = lengths[-1]
        counts[largest] -= 1
        if not counts[largest]:
            lengths.pop()
        filling = [largest, *best_filling(capacity - largest, counts, lengths)]
        counts[largest] += 1
        if counts[largest] == 1:
            lengths.append(largest)
        each = Counter(filling)
        times = min(counts[k] // n for k, n in each.items())
        patterns.append((times, filling))
        total -= times * len(filling)
        for k, n in each.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
                lengths.pop(bisect.bisect_left(lengths, k))
    rest = [k for k, n in counts.items() for _ in range(n)]
    return patterns + [(1, b) for b in (search(rest, capacity) if rest else [])]


# dealing the plan to the pieces -------------------------------------------------------------------------


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, pieces of it in a sequence, offset of the first)."""
    used: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for times, filling in patterns:
        offset = 0
        for length, n in sorted(Counter(filling).items(), reverse=True):
            rows.setdefault(length, []).append((used[length], sequence, n, offset))
            used[length] += times * n
            offset += length * n
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry length, task and nth (see ``tokenised``).

    The pieces must be a stored table: they are read for the histogram and again for the places. The histogram
    (at most ``capacity`` lines) and the plan (a few lines per length) are all that the driver holds.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    # pieces of a length are ranked by task, then by their number within it: a window of one line per task
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = (
        pieces.withColumnsRenamed({"length": "_length", "task": "_task"})
        .join(starts.select("length", "task", "before"), (F.col("_length") == F.col("length")) & (F.col("_task") == F.col("task")))
        .withColumn("_rank", F.col("before") + F.col("nth"))
        .drop("_length", "_task", "task", "nth", "before")
    )
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            rank, length = frame.pop("_rank").to_numpy(), frame["length"].to_numpy()
            sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                k = int(length[rows[0]])
                own = table[k]
                at = own[np.searchsorted(own[:, 0], rank[rows], side="right") - 1]
                step = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 1] + step // at[:, 2]
                offset[rows] = at[:, 3] + k * (step % at[:, 2])
            yield frame.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(deal, schema)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null text is an empty document of one token. Repeated rows and null keys are packed as documents of their
    own; other columns are left out; an empty table gives no rows.
    """
    pieces = written(tokenised(docs, vocabulary, capacity=capacity, key=key, text=text), "pieces")
    return packed(pieces, capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
