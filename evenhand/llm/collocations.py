"""Phrase collocations by partitioned (SON) mining.

Every document belongs to one of a few shards. First each shard is mined completely, level by level: a phrase of m
words is counted only where both its parts of m - 1 words are frequent in the shard, and frequent means the support
lowered by the shard's share of all words, so a phrase that is frequent at large is frequent in one shard at least.
The union of what the shards found, less what cannot reach the support with the others' counts, is then counted over all documents, exactly, by the words themselves; phrases
below the support go. What is frequent is told to the scanning tasks by bit filters: a filter may let too much
through, which costs counting, and never too little. Counts are summed within a task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import shipped, written

SHARD_BITS, CODE_BITS = 3, 12
SLICE_BYTES = 4 << 20
#: Lines of phrases that a scanning task holds before it sums them, and what it hands on early if sums stay above.
HELD_LINES, HELD_SUMS = 600_000, 400_000
#: A filter has ten bits for every key, up to 2**28 bits (32 MB); beyond that it lets more through.
FILTER_BITS = (16, 28)

#: Fixed values of the texts' reading: what ends a piece, and what parts words.
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TO = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS + BLANKS, bytes(range(97, 123)) + b"\n" * len(PIECE_ENDS) + b"  ")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _chain(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase out of that of all but its last word, and that word's."""
    return _mixed(head * _ODD + word)


class _Slice:
    """The words of some documents: number, hash, piece and row of each."""

    def __init__(self, texts: pa.Array, langs: list[str], rows: np.ndarray, shards: np.ndarray):
        pieces = pc.split_pattern(texts, "\n")
        of_text = pc.list_parent_indices(pieces).to_numpy()
        words = pc.split_pattern(pc.list_flatten(pieces), " ")
        of_piece = pc.list_parent_indices(words).to_numpy()
        encoded = pc.list_flatten(words).dictionary_encode()
        number = encoded.indices.to_numpy()
        self.words = encoded.dictionary
        empty = pc.index(self.words, pa.scalar("", self.words.type)).as_py()
        if empty >= 0:
            kept = number != empty
            number, of_piece = number[kept], of_piece[kept]
        self.number, self.piece = number.astype(np.int64), of_piece
        self.row = rows[of_text[of_piece]]
        self.langs, self.shards = langs, shards

    def prepare(self, sharded: bool) -> None:
        """Hashes of the words, and the number of each word's language and shard."""
        hashes = pd.util.hash_array(np.array(self.words.to_pylist(), object)) if len(self.words) else np.zeros(0, np.uint64)
        by_lang = {lang: i for i, lang in enumerate(dict.fromkeys(self.langs))}
        of_lang = np.array([by_lang[x] for x in self.langs], np.int64)
        salts = pd.util.hash_array(np.array(list(by_lang), object)) if by_lang else np.zeros(0, np.uint64)
        code = (salts[of_lang] % np.uint64(1 << (CODE_BITS - SHARD_BITS))) << np.uint64(SHARD_BITS)
        if sharded:
            code = code | self.shards.astype(np.uint64)
        self.names, self.lang = list(by_lang), of_lang[self.row]
        self.code = code[self.row]
        self.salt = salts[self.lang]
        self.hash = hashes[self.number]

    def keys(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << CODE_BITS) - 1)
        return (_mixed(hashes + self.salt[at]) & ~low) | self.code[at]

    def levels(self, filters: list, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(m, places, keys) for m up to ``size``: where a phrase of m words starts whose parts pass the filters.

        The phrases of the levels that have a filter have passed it themselves.
        """
        at, hashes = np.arange(len(self.number)), self.hash
        for m in range(1, size + 1):
            if m > 1:
                follows = np.zeros(len(self.number) + 1, bool)
                follows[at] = True
                last = np.minimum(at + m - 1, len(self.number) - 1)
                kept = follows[at + 1] & (at + m - 1 == last) & (self.piece[at] == self.piece[last])
                at, hashes, last = at[kept], hashes[kept], last[kept]
                hashes = _chain(hashes, self.hash[last])
            keys = self.keys(at, hashes)
            if m <= len(filters):
                passed = filters[m - 1].has(keys)
                at, hashes, keys = at[passed], hashes[passed], keys[passed]
            yield m, at, keys


def _slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[_Slice]:
    """A batch of (lang, shard, text) in slices of a bounded number of bytes; long texts are cut between pieces."""
    column = batch.column(2).cast(pa.large_binary())
    lengths = pc.binary_length(column).to_numpy()
    langs, shards = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    start = 0
    while start < len(lengths):
        total, end = 0, start
        while end < len(lengths) and (end == start or total + lengths[end] <= limit):
            total += lengths[end]
            end += 1
        texts = [column[i].as_py().translate(_TO) for i in range(start, end)]
        if total <= limit:
            rows = np.arange(start, end)
            yield _Slice(pa.array(texts, pa.binary()).cast(pa.string()), langs, rows, shards)
        else:  # one long text
            text, at = texts[0], 0
            while at < len(text):
                cut = text.find(b"\n", at + limit)
                cut = len(text) if cut < 0 else cut
                yield _Slice(pa.array([text[at:cut]], pa.binary()).cast(pa.large_string()), langs, np.array([start]), shards)
                at = cut + 1
        start = end


class BitFilter:
    """Keys hashed to three bits each; bounded in size, without false negatives."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - bits)
        return [(keys * np.uint64(c)) >> shift for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self.probes(keys, self.bits):
            bit = np.uint64(1) << (p & np.uint64(63))
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] & bit) != 0
        return found

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> BitFilter:
        """The filter of a table's ``key``; at most 2**22 words of it come to the driver."""
        low, high = FILTER_BITS
        bits = min(max(low, int(10 * n).bit_length()), high)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                probes = np.concatenate(cls.probes(batch.column(0).to_numpy().view(np.uint64), bits))
                word, bit = (probes >> np.uint64(6)).astype(np.int64), np.uint64(1) << (probes & np.uint64(63))
                order = np.argsort(word, kind="stable")
                word, bit = word[order], bit[order]
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
                merged = np.bitwise_or.reduceat(bit, first) if len(word) else bit
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(merged.view(np.int64))], names=["word", "bits"])

        found = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return cls(words, bits)


def _counted(rows: DataFrame, filters, size: int) -> DataFrame:
    """(key, n) of the phrases of ``size`` words whose parts pass the shards' filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        for batch in batches:
            for part in _slices(batch):
                part.prepare(sharded=True)
                for m, _, keys in part.levels(known, size):
                    if m == size:
                        keys, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _mined(rows: DataFrame, support: int, longest: int) -> list[BitFilter]:
    """Per length the filter of all phrases that some shard found frequent and that can reach the support at large."""
    spark = rows.sparkSession
    code = F.col("key").bitwiseAND((1 << CODE_BITS) - 1)
    local, union = [], []
    least = None
    for m in range(1, longest + 1):
        counts = _counted(rows, spark.sparkContext.broadcast(local), m)
        if m == 1:
            counts = written(counts, "shard-words")
            sizes = {r["code"]: r["n"] for r in counts.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect()}  # 4,096 at most
            together: dict[int, int] = {}
            for c, n in sizes.items():
                together[c >> SHARD_BITS] = together.get(c >> SHARD_BITS, 0) + n
            bounds = {c: -(-support * n // together[c >> SHARD_BITS]) for c, n in sizes.items()}
            needed: dict[int, int] = {}
            for c, n in bounds.items():
                needed[c >> SHARD_BITS] = needed.get(c >> SHARD_BITS, support) - (n - 1)
            least = spark.createDataFrame([(c, n, needed[c >> SHARD_BITS]) for c, n in bounds.items()], "code long, least long, needed long")
        frequent = counts.withColumn("code", code).join(F.broadcast(least), "code").where("n >= least")
        frequent = frequent.select("key", (F.col("n") - F.col("least") + 1).alias("more"), "needed")
        frequent = written(frequent, f"shard-frequent-{m}")
        n = frequent.count()
        local.append(BitFilter.of(frequent, n))
        shard = (1 << SHARD_BITS) - 1
        # where a phrase was not found it has less than that shard's least; with what the others counted it must reach the support
        possible = frequent.groupBy(F.col("key").bitwiseAND(~shard).alias("key")).agg(F.sum("more").alias("more"), F.first("needed").alias("needed"))
        union.append(BitFilter.of(possible.where("more >= needed"), n))
        if n == 0:
            break
    return union


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n) with one line for a phrase, as long as a bounded number of lines holds them all."""
    held, lines = [], 0

    def summed() -> pa.Table:
        whole = pa.Table.from_batches(held)
        sums = whole.group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return sums.select(["lang", "words", "phrase", "n_sum"]).rename_columns(whole.column_names)

    for batch in batches:
        held.append(batch)
        lines += batch.num_rows
        if lines > HELD_LINES:
            sums = summed()
            if sums.num_rows > HELD_SUMS:
                yield from sums.to_batches()
                sums = sums.slice(0, 0)
            held, lines = sums.to_batches(), sums.num_rows
    if held:
        yield from summed().to_batches()


def phrase_counts(
    docs: DataFrame, support: int, longest: int, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all phrases with at least ``support`` occurrences in a language.

    A line of ``words`` = 0 has the number of all word occurrences of a language that has words.
    """
    shipped(docs.sparkSession)
    shard = F.pmod(F.xxhash64(key, text), F.lit(1 << SHARD_BITS)).cast("int")
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    filters = docs.sparkSession.sparkContext.broadcast(_mined(rows, support, longest))
    names = ["lang", "words", "phrase", "n"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value
        for batch in batches:
            for part in _slices(batch):
                part.prepare(sharded=False)
                totals = np.bincount(part.lang, minlength=len(part.names))
                held = [i for i, n in enumerate(totals) if n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.names[i] for i in held], pa.string()), pa.array([0] * len(held), pa.int32()),
                     pa.array([""] * len(held), pa.string()), pa.array(totals[held], pa.int64())], names=names)
                own = np.zeros(len(part.number), np.int64)  # the number of the phrase that starts here, one word shorter
                for m, at, _ in part.levels(known, len(known)):
                    head = part.lang[at] if m == 1 else own[at]
                    pair = head * np.int64(len(part.words)) + part.number[at + m - 1]
                    _, first, number, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                    own[at] = number
                    where = at[first]
                    words = [part.words.take(pa.array(part.number[where + j])).cast(pa.string()) for j in range(m)]
                    phrase = words[0] if m == 1 else pc.binary_join_element_wise(*words, " ")
                    langs = pa.array(np.array(part.names, object)[part.lang[where]], pa.string())
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(len(n), m, np.int32)), phrase, pa.array(n, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a phrase is in nearly every slice, so a task sums its slices
        yield from _summed(lines(batches))

    counts = rows.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return counts.where((F.col("words") == 0) | (F.col("n") >= support))


def collocations(
    docs: DataFrame,
    support: int = 100,
    longest: int = 5,
    first: int = 2000,
    share: int = 100,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of every language.

    A to Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words at blanks. A phrase of 2 to ``longest`` words
    counts with ``support`` occurrences; its score is that of its lowest cut, floor(1000 a n / (l r)), the first of
    ties. It goes if a longer phrase around it has ``share`` percent of its occurrences: any such phrase holds one that
    is a word longer and has as many, so only those are looked up. Null languages are ``und``, null texts empty;
    repeated rows count as often as they stand; a language without such a phrase has no line; an empty table gives
    no line. Other columns are not read.
    """
    counts = written(phrase_counts(docs, support, longest, key, text, lang), "phrases")
    totals = counts.where("words = 0").select("lang", F.col("n"))
    known = counts.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    inner = "concat_ws(' ', slice(w, {}, {}))"
    split = phrases.withColumn("w", F.split("phrase", " "))
    longer = split.where("words > 2").select(
        "lang", F.explode(F.array(F.expr(inner.format(1, "words - 1")), F.expr(inner.format(2, "words - 1")))).alias("phrase"), F.col("a").alias("around")
    )
    around = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = split.join(around, ["lang", "phrase"], "left").where((F.col("around").isNull()) | (100 * F.col("around") < share * F.col("a")))
    cuts = left.select("lang", "phrase", "words", "w", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr(inner.format(1, "k")).alias("head"), F.expr(inner.format("k + 1", "words - k")).alias("tail")
    )
    scored = (
        cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
        .join(totals, "lang")
        .withColumn(
            "score",
            F.expr("(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"),
        )
    )
    lowest = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("c"))
    ranked = lowest.select("lang", "phrase", "c.*").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    )
    return ranked.where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
