"""Token ids in wavelet-matrix files.

Texts are dealt by ranges of their key, sorted, tokenised and written by the task that holds the range, one file
per ``shard_tokens`` ids. A file holds one bit-plane per bit of a token's code (codes by falling frequency, so the
upper planes are nearly empty), each cut into segments that are compressed by themselves, with the number of ones
before every segment. Access, rank (counting) and select (occurrences) read one segment per plane; reading all ids
back undoes the stable partitions plane by plane, from the lowest one up.

Files are written through ``pyarrow.fs`` below the shared folder, under a name of their own first and moved when
whole, so a repeated task changes nothing; they are read back with Spark's ``binaryFile`` reader. Keys that hold a
large share of all rows are dealt by the text and the row's place as well.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import shipped, vocabulary_path, written
from evenhand.session import scratch_path

MAGIC = b"WAVMAT01"
SHARD_TOKENS = 1 << 22
SEGMENT_BITS = 1 << 16
_HEAD = struct.Struct("<8s7Q")


# tokens -------------------------------------------------------------------------------------------------

#: A space between two characters that no Unicode version calls white space starts a part of its own, whatever
#: stands around it; where a space has other white space behind it, or ends the text, only such spaces split.
_IRREGULAR = re.compile(r" (?:[\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u206f\u3000\ufeff]|$)")
_PLAIN = r"[!-~\xa1-\u02ff\u0370-\u167f\u3041-\ud7ff]"
_SPLIT = re.compile(f"(?<={_PLAIN}) (?={_PLAIN})")
#: A letter with such a character behind it at the end of a word: the last character is a part of its own.
_ENDED = re.compile(r"[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u017f][.,;:!?]\Z")

#: Words of such letters are one part, and stay one whatever the Unicode version.
_LETTERS = re.compile(r"[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")
#: The vocabulary writes a byte as the character of its number, and those that cannot be seen as the ones from 256 on.
_UNSEEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(40)]
_SHOWN = {b: 256 + i for i, b in enumerate(_UNSEEN)}


class WordTable:
    """Distinct words, each with the space before it, and their ids (packed); bounded, starts anew when full."""

    def __init__(self, vocabulary: str, entries: int = 1_200_000, together: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.entries, self.together = entries, together
        self.words: dict[str | None, bytes] = {None: b""}
        self.firsts: dict[str, bytes] = {}
        self.ends = {c: self.ids(c) for c in ".,;:!?"}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        split = [(_SPLIT.split(t) if _IRREGULAR.search(t) else t.split(" ")) for t in texts]
        firsts = [self._first(words[0]) for words in split]
        for words in split:
            words[0] = None
        self._learn(set().union(*split))
        got = self.words.__getitem__
        return [first + b"".join(map(got, words)) for first, words in zip(firsts, split, strict=True)]

    def _first(self, word: str) -> bytes:
        """The word that a text starts with has no space before it."""
        if word not in self.firsts:
            if len(self.firsts) > self.entries // 10:
                self.firsts.clear()
            self.firsts[word] = self.ids(word)
        return self.firsts[word]

    def _learn(self, words: set) -> None:
        fresh = words.difference(self.words)
        if len(self.words) + len(fresh) > self.entries:
            self.words = {None: b""}
            fresh = words - {None}
        ended = [w for w in fresh if _ENDED.search(w)]
        self._encode([w for w in {*fresh.difference(ended), *(w[:-1] for w in ended)} if w not in self.words])
        for w in ended:
            self.words[w] = self.words[w[:-1]] + self.ends[w[-1]]

    def _encode(self, words: list[str]) -> None:
        """A word of plain letters is one part, which the tokenizer's model takes as it is. Of the others many are
        encoded at once and cut where a token opens with a space, as a space starts a part."""
        tokenize, plain, odd = self.tokenizer.model.tokenize, [], []
        for w in words:
            if _LETTERS.fullmatch(w):
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN)
                ids = [t.id for t in tokenize("Ġ" + shown)]
                self.words[w] = _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else np.array(ids, "<u4").tobytes()
            else:
                (odd if " " in w else plain).append(w)
        groups = [plain[i : i + self.together] for i in range(0, len(plain), self.together)]
        encoded = self.tokenizer.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, found in zip(groups, encoded, strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(group):
                odd += group
                continue
            flat, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
            at = 0
            for word, end in zip(group, ends, strict=True):
                self.words[word] = flat[at:end]
                at = end
        for word in odd:
            self.words[word] = self.ids(" " + word)


_TABLES: dict[str, WordTable] = {}


def word_table(vocabulary: str) -> WordTable:
    if vocabulary not in _TABLES:
        _TABLES[vocabulary] = WordTable(vocabulary)
    return _TABLES[vocabulary]


# the file -----------------------------------------------------------------------------------------------


def build(ids: np.ndarray, keys: pa.Array, lengths: np.ndarray, part: int = 0, shard: int = 0) -> bytes:
    """One file: the ids of all documents one behind the other, their keys and lengths."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    alphabet = used[np.argsort(-counts[used], kind="stable")]
    code_of = np.zeros(len(counts), np.uint32)
    code_of[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    if len(alphabet) <= 1 << 16:
        code_of = code_of.astype(np.uint16)
    now = code_of[ids]
    width = max(1, int(max(len(alphabet) - 1, 0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = []
    for level in reversed(range(width)):
        bits = (now & now.dtype.type(1 << level)) != 0
        packed = np.packbits(bits, bitorder="little").tobytes()
        step = SEGMENT_BITS // 8
        segments, ones, at = [], [0], [0]
        for i in range(0, len(packed), step):
            raw = packed[i : i + step]
            small = squeeze(raw)
            segments.append(small if len(small) < len(raw) else raw)
            at.append(at[-1] + len(segments[-1]))
            ones.append(ones[-1] + int(np.count_nonzero(bits[i * 8 : i * 8 + SEGMENT_BITS])))
        head = struct.pack("<2Q", len(ids) - ones[-1], len(segments))
        planes.append(head + np.array(ones, "<u8").tobytes() + np.array(at, "<u8").tobytes() + b"".join(segments))
        # places first: taking by them is several times as fast as by a mask of unforeseeable bits
        now = np.concatenate([now.take(np.flatnonzero(~bits)), now.take(np.flatnonzero(bits))])
    sink = pa.BufferOutputStream()
    documents = pa.record_batch([keys, pa.array(lengths, pa.int64())], names=["key", "length"])
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(documents)
    table, letters = sink.getvalue().to_pybytes(), squeeze(alphabet.astype("<u4").tobytes())
    head = _HEAD.pack(MAGIC, part, shard, len(ids), width, len(alphabet), len(table), len(letters))
    return head + table + letters + b"".join(planes)


class _Plane:
    def __init__(self, data: memoryview, at: int, n: int):
        self.zeros, self.segments = struct.unpack_from("<2Q", data, at)
        at += 16
        size = 8 * (self.segments + 1)
        self.ones = np.frombuffer(data[at : at + size], "<u8").astype(np.int64)
        self.offsets = np.frombuffer(data[at + size : at + 2 * size], "<u8").astype(np.int64)
        self.start = at + 2 * size
        self.end = self.start + int(self.offsets[-1])
        self.data, self.n = data, n
        self.held: dict[int, np.ndarray] = {}

    def bits(self, segment: int) -> np.ndarray:
        if segment not in self.held:
            if len(self.held) >= 8:
                self.held.clear()
            raw = bytes(self.data[self.start + self.offsets[segment] : self.start + self.offsets[segment + 1]])
            n = min(SEGMENT_BITS, self.n - segment * SEGMENT_BITS)
            if len(raw) != (n + 7) // 8:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            self.held[segment] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little")
        return self.held[segment]

    def all(self) -> np.ndarray:
        parts = []
        for s in range(self.segments):
            parts.append(self.bits(s))
            self.held.clear()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place, 0 to n."""
        out = np.empty(len(at), np.int64)
        segment = np.minimum(at // SEGMENT_BITS, self.segments)
        for s in np.unique(segment):
            here = segment == s
            inside = at[here] - s * SEGMENT_BITS
            if s == self.segments or not inside.any():
                out[here] = self.ones[s]
                continue
            sums = np.concatenate([[0], np.cumsum(self.bits(int(s)), dtype=np.int64)])
            out[here] = self.ones[s] + sums[inside]
        return out

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.uint8)
        segment = places // SEGMENT_BITS
        for s in np.unique(segment):
            here = segment == s
            out[here] = self.bits(int(s))[places[here] - s * SEGMENT_BITS]
        return out

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """The place of the ones (or zeros) with these ranks, from 0."""
        before = self.ones if bit else np.minimum(np.arange(self.segments + 1) * SEGMENT_BITS, self.n) - self.ones
        segment = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for s in np.unique(segment):
            here = segment == s
            out[here] = np.flatnonzero(self.bits(int(s)) == bit)[ranks[here] - before[s]] + s * SEGMENT_BITS
        return out


class WaveletFile:
    """A file read back: token access, counting and occurrences, and all ids at once."""

    def __init__(self, content: bytes):
        data = memoryview(content)
        magic, self.part, self.shard, self.n, width, n_codes, table, letters = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        at = _HEAD.size
        documents = pa.ipc.open_stream(pa.py_buffer(data[at : at + table])).read_all().combine_chunks()
        self.keys = documents.column("key").combine_chunks()
        self.lengths = documents.column("length").to_numpy()
        at += table
        self.alphabet = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data[at : at + letters]), max_output_size=4 * n_codes), "<u4") if n_codes else np.zeros(0, "<u4")
        at += letters
        self.planes: list[_Plane] = []
        for _ in range(width):
            self.planes.append(_Plane(data, at, self.n))
            at = self.planes[-1].end
        self.codes = {int(t): c for c, t in enumerate(self.alphabet)}

    def __len__(self) -> int:
        return self.n

    def access(self, places) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the file")
        code = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.at(at), plane.ones_before(at)
            code = code * 2 + bit
            at = np.where(bit == 1, plane.zeros + ones, at - ones)
        return self.alphabet[code]

    def _interval(self, code: int, low: int, high: int) -> tuple[int, int]:
        ends = np.array([low, high], np.int64)
        for level, plane in zip(reversed(range(len(self.planes))), self.planes, strict=True):
            ones = plane.ones_before(ends)
            ends = plane.zeros + ones if code >> level & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the token stands at places low to high (exclusive)."""
        if token not in self.codes:
            return 0
        low, high = self._interval(self.codes[token], low, self.n if high is None else high)
        return high - low

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """The places of the token within low to high, ascending."""
        if token not in self.codes:
            return np.zeros(0, np.int64)
        code = self.codes[token]
        low, high = self._interval(code, low, self.n if high is None else high)
        at = np.arange(low, high, dtype=np.int64)
        for level, plane in enumerate(reversed(self.planes)):
            at = plane.select(1, at - plane.zeros) if code >> level & 1 else plane.select(0, at)
        return at

    def ids(self) -> np.ndarray:
        """All ids: the planes' partitions undone from the lowest plane up."""
        code = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            one = plane.all().view(bool)
            above = np.empty_like(code)
            above[np.flatnonzero(~one)] = code[: plane.zeros]
            above[np.flatnonzero(one)] = code[plane.zeros :] | code.dtype.type(1 << level)
            code = above
        return self.alphabet[code]


# Spark --------------------------------------------------------------------------------------------------


def _put(folder: str, name: str, content: bytes) -> None:
    """Write a file whole or not at all, whatever store the folder is in."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(content)
    store.move(own, f"{root}/{name}")


def write_files(
    docs: DataFrame,
    folder: str | None = None,
    vocabulary: str = "byte_bpe_50k.json",
    end: int = 0,
    shard_tokens: int = SHARD_TOKENS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write all documents, in ascending order of their key, as wavelet files; one row per file comes back:
    (folder, name, part, shard, n_docs, n_tokens, start), ``start`` being the ids in all files before.

    A document is its text's ids, then ``end``. Null texts count as empty; null keys come first; rows of equal keys
    are documents of their own, in the order of a hash of their texts (any order changes nothing for equal rows).
    A document is never cut: one longer than ``shard_tokens`` has a file of its own size. An empty table gives no
    file. Other columns are not read.
    """
    spark = docs.sparkSession
    shipped(spark)
    folder = folder or scratch_path(spark, "wavelet")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("key").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = word_table(vocabulary), TaskContext.get().partitionId()
        tail = end.to_bytes(4, "little")
        keys, found, held, shard = [], [], 0, 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in found], np.int64)
            ids = np.frombuffer(b"".join(found), "<u4")
            name = f"{part:06d}-{shard:06d}.wavelet"
            _put(folder, name, build(ids, pa.concat_arrays(keys), lengths, part, shard))
            return pa.RecordBatch.from_pylist([dict(name=name, part=part, shard=shard, n_docs=len(lengths), n_tokens=len(ids))], schema=out_schema)

        out_schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                fresh = [x + tail for x in table.of(piece.column(1).to_pylist())]
                at = 0
                for i, x in enumerate(fresh):
                    found.append(x)
                    held += len(x) // 4
                    if held >= shard_tokens:
                        keys.append(piece.column(0).slice(at, i + 1 - at))
                        yield close()
                        keys, found, held, shard, at = [], [], 0, shard + 1, i + 1
                if at < len(fresh):
                    keys.append(piece.column(0).slice(at))
        if found:
            yield close()

    files = written(dealt.mapInArrow(run, "name string, part int, shard int, n_docs long, n_tokens long"), "wavelet-files")
    # one row per task, then one per file of a task
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    out = files.join(before, "part").withColumn("start", F.col("_before") + within)
    return out.select(F.lit(folder).alias("folder"), "name", "part", "shard", "n_docs", "n_tokens", "start")


def _read(files: DataFrame, run, schema: str) -> DataFrame:
    """Every file through ``run``, a function from a file to Arrow columns; rows get ``part`` and ``shard``."""
    spark = files.sparkSession
    folders = [r["folder"] for r in files.select("folder").distinct().collect()]
    if not folders:
        return spark.createDataFrame([], f"part int, shard int, {schema}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = WaveletFile(content.as_py())
                columns = run(file)
                n = len(next(iter(columns.values())))
                own = {"part": pa.array(np.full(n, file.part, np.int32)), "shard": pa.array(np.full(n, file.shard, np.int32))}
                yield pa.RecordBatch.from_pydict({**own, **columns})

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wavelet").load(folders).select("content")
    return raw.mapInArrow(each, f"part int, shard int, {schema}")


def read_documents(files: DataFrame, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of every document, out of the files of :func:`write_files`."""

    def run(file: WaveletFile) -> dict:
        raw = file.ids().astype("<u4").tobytes()
        ends = np.cumsum(file.lengths)
        cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), file.lengths.tolist(), strict=True)]
        return {
            key: file.keys,
            "offset": pa.array(ends - file.lengths),
            "n_tokens": pa.array(file.lengths),
            "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()),
            "ids": pa.array(cut, pa.binary()),
        }

    rows = _read(files, run, f"`{key}` {key_type}, offset long, n_tokens long, ids_crc32 long, ids binary")
    starts = files.select("part", "shard", F.col("start").alias("_start"))
    return rows.join(starts, ["part", "shard"]).select(key, (F.col("_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of these ids stands in all files; two ranks per plane and file."""

    def run(file: WaveletFile) -> dict:
        return {"token": pa.array(tokens, pa.int64()), "n": pa.array([file.count(t) for t in tokens], pa.int64())}

    return _read(files, run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(files: DataFrame, token: int, key: str = "doc_id", key_type: str = "bigint") -> DataFrame:
    """(key, place): every occurrence of an id, with its place within its document."""

    def run(file: WaveletFile) -> dict:
        at = file.occurrences(token)
        ends = np.cumsum(file.lengths)
        doc = np.searchsorted(ends, at, side="right")
        return {key: file.keys.take(pa.array(doc)), "place": pa.array(at - (ends - file.lengths)[doc], pa.int64())}

    return _read(files, run, f"`{key}` {key_type}, place long").drop("part", "shard")


def key_type(docs: DataFrame, key: str = "doc_id") -> str:
    return docs.schema[key].dataType.simpleString()


def round_trip(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """All documents written as files and read back: (key, start, n_tokens, ids_crc32, ids)."""
    return read_documents(write_files(docs, key=key, **options), key, key_type(docs, key))

