"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary holds a whitespace marker behind another character (checked when the model is
loaded), so merges never cross the start of a run of markers. A text is therefore the sequence of its marked
words; each distinct marked word is segmented once per worker and its ids are joined back by position. The
table is bounded: it starts anew when it is full, which costs time and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import shipped, vocabulary_path

MARK = "▁"
TABLE_ENTRIES = 400_000


class ChunkTable:
    """Distinct marked words and their ids (packed little-endian unsigned 32-bit)."""

    def __init__(self, model: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._plain()
        self.entries = entries
        # a marker alone, as behind a space that ends a text
        self.alone = {"": packed([self.model.piece_to_id(MARK)])}
        self.ids: dict[str, bytes] = dict(self.alone)
        self.odd: dict[str, str] = {}  # words that decode to something else

    def _plain(self) -> bool:
        """The model must change no character and mark the start of a text, else words are not independent."""
        probe = ["", " ", "a", " a", "a  b ", "Ａﬁ\t\n", "é é"]
        return all(self.model.decode(x) == t for x, t in zip(self.model.encode(probe), probe, strict=True)) and (
            self.model.encode("a", out_type=str)[0].startswith(MARK)
        )

    def _learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self.ids))
        if not fresh:
            return
        if len(self.ids) + len(fresh) > self.entries:
            self.ids = dict(self.alone)
            self.odd.clear()
            fresh = list(words - {""})
        found = self.model.encode(fresh, num_threads=1)
        for word, ids, back in zip(fresh, found, self.model.decode(found, num_threads=1), strict=True):
            self.ids[word] = packed(ids)
            if back != word:
                self.odd[word] = back

    def both(self, text: str) -> tuple[bytes, str]:
        """Ids without begin and end, and the text they decode to."""
        if not self.separable:
            ids = self.model.encode(text)
            return packed(ids), self.model.decode(ids)
        if not text:
            return b"", ""
        text = text.replace(MARK, " ")
        # the first marker is the one that the model puts before every text
        words = [x[1:] for x in re.findall(" +[^ ]*", " " + text)] if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")
        self._learn(set(words))
        ids = b"".join(map(self.ids.__getitem__, words))
        if self.odd:
            return ids, " ".join([self.odd.get(w, w) for w in words])
        return ids, " ".join(words)


def packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model: str) -> ChunkTable:
    """One table per worker process, kept between tasks."""
    if model not in _TABLES:
        _TABLES[model] = ChunkTable(model)
    return _TABLES[model]


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row: ids with begin and end as packed little-endian unsigned 32-bit integers.

    A null text counts as empty. Rows with equal or null keys stay rows of their own; other columns are left
    out; an empty table gives an empty table.
    """
    shipped(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        begin, end = packed([table.model.bos_id()]), packed([table.model.eos_id()])
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # bounds what is held at once
                part = batch.slice(start, 512)
                ids, decoded = [], []
                for value in part.column(1):
                    i, d = table.both(value.as_py())
                    ids.append(begin + i + end)
                    decoded.append(d)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[key, "ids", "decoded"],
                )

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return encoded.select(
        F.col(key),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
