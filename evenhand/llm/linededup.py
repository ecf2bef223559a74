"""Line deduplication by a deletion-neighbourhood join.

Two lines are alike if they are equal, or both are long enough and one edit (a character put in, taken out or
changed) turns one into the other. A line goes if an earlier line is alike, so the earliest always stays.

One edit leaves one half of a line as it is. So only lines that share a half, and then a length to within one,
come to the neighbourhood join: each emits, as hashed keys, what is left when one character of the other half is
taken out. Equal keys with the same place differ by a change, a key that equals a whole line by one character more.
The lines of a key are alike to one another, so each key only needs its earliest lines, never its pairs. Every find
is verified by its edit distance.

All of it is DataFrame functions; keys are 64-bit, lines are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import settled, shielded, written

#: Lines shorter than this are duplicates only if they are equal.
MIN_CHARS = 20


def _left(line: Column, n: Column) -> Column:
    return F.substring(line, F.lit(1), n)


def _right(line: Column, n: Column, length: Column) -> Column:
    return F.substring(line, length - n + 1, n)


def _half(length: Column) -> Column:
    """Characters of a half: not more than an edit leaves untouched, in steps so that near lengths agree."""
    half = F.floor((length - 1) / 2).cast("int")
    return half - half % 4


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(pos, doc, line, h1, h2): every line that is not blank; pos is (key is null, key, line number)."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.select("_key", F.xxhash64("_text").alias("doc"), F.posexplode(F.split("_text", "\n", -1)).alias("no", "line"))
    return rows.where(F.length(F.trim("line")) > 0).select(
        F.struct(F.isnull("_key").alias("last"), F.col("_key").alias("key"), F.col("no").alias("no")).alias("pos"),
        "doc",
        "line",
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
    )


def _anchors(line: Column, length: Column) -> dict[str, Column]:
    """Hashed halves of a line: of its own half length, and where that differs of that of a line one shorter."""
    own, shorter = _half(length), _half(length - 1)
    front = lambda n: F.xxhash64(F.lit(0), n, _left(line, n))
    back = lambda n: F.xxhash64(F.lit(1), n, _right(line, n, length))
    other = shorter != own
    return {"front": front(own), "back": back(own), "front_1": F.when(other, front(shorter)), "back_1": F.when(other, back(shorter))}


def _unfolded(distinct: DataFrame) -> DataFrame:
    """A row for every half of a line: (h1, h2, first, length, anchor, h, front)."""
    length = F.col("length")
    sides = [("front", _half(length), True), ("back", _half(length), False), ("front_1", _half(length - 1), True), ("back_1", _half(length - 1), False)]
    halves = F.array(*[F.struct(F.col(c).alias("anchor"), h.alias("h"), F.lit(front).alias("front")) for c, h, front in sides])
    return distinct.select("h1", "h2", "first", "length", F.inline(halves)).where(F.col("anchor").isNotNull())


def alike(lines: DataFrame, distinct: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line at one edit.

    ``distinct``: (h1, h2, first, length, halves) stored, one row per line; ``lines`` has their texts.
    """
    long = _unfolded(distinct.where(F.col("length") >= min_chars))
    # first sieve: a half in common with another line; second sieve: and a length to within one
    shared = long.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    members = settled(long.join(shared, "anchor"))
    sizes = members.groupBy("anchor", "length").agg(F.count(F.lit(1)).alias("n"))
    beside = (
        sizes.union(sizes.select("anchor", F.col("length") + 1, F.lit(-1).cast("long")))
        .union(sizes.select("anchor", F.col("length") - 1, F.lit(-2).cast("long")))
        .groupBy("anchor", "length")
        .agg(
            F.max("n").alias("same"),
            F.max(F.col("n") == -1).alias("shorter"),
            F.max(F.col("n") == -2).alias("longer"),
        )
        .where("same > 0 and (same > 1 or shorter or longer)")
    )
    wanted = settled(
        members.join(beside, ["anchor", "length"])
        .groupBy("h1", "h2", "first", "length", "front")
        .agg(F.min("h").alias("h"), F.max(F.col("same") > 1).alias("change"), F.max("shorter").alias("shorter"), F.max("longer").alias("longer"))
    )
    texts = lines.join(wanted.select("h1", "h2").distinct(), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = written(texts, "texts")
    # the character taken out lies outside the half that is shared
    place = F.when(F.col("front"), F.sequence(F.col("h"), F.col("length") - 1)).otherwise(F.sequence(F.lit(0), F.col("length") - 1 - F.col("h")))
    rows = wanted.join(texts, ["h1", "h2"]).withColumn("line_id", F.struct("first", "h1", "h2"))
    out = rows.where(F.col("change") | F.col("shorter")).select(
        "line_id", "change", "shorter", F.explode(F.transform(place, lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.substring(F.col("line"), F.lit(1), i), F.substring(F.col("line"), i + 2, F.col("length")))).alias("v")))).alias("x")
    )
    # kinds: 0 a changed character, 1 one character more, 2 a whole line
    keys = (
        out.where("change").select("line_id", F.lit(0).alias("kind"), F.xxhash64("x.v", "x.i").alias("key"))
        .union(out.where("shorter").select("line_id", F.lit(1), F.col("x.v")))
        .union(rows.where("longer").select("line_id", F.lit(2), F.xxhash64("line")))
    )
    keys = written(keys, "neighbours")
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("line_id")))
    last = F.max(F.when(F.col("kind") == 0, F.col("line_id")))
    earliest = (
        keys.groupBy("key")
        .agg(of(0).alias("changed"), of(1).alias("more"), of(2).alias("whole"), last.alias("last"))
        .where("changed <> last or (more is not null and whole is not null)")
    )
    other = F.when(F.col("kind") == 0, F.col("changed")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("more"))
    finds = keys.join(earliest.drop("last"), "key").withColumn("other", other).where("other.first < line_id.first")
    finds = finds.select(
        F.col("line_id.h1").alias("h1"), F.col("line_id.h2").alias("h2"), F.col("other.h1").alias("g1"), F.col("other.h2").alias("g2")
    ).distinct()
    earlier = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("earlier"))
    verified = finds.join(texts, ["h1", "h2"]).join(earlier, ["g1", "g2"]).where(F.levenshtein("line", "earlier", 1).between(0, 1))
    return verified.select("h1", "h2").distinct()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of the documents, the text without its repeated lines, and (n_lines, n_dropped).

    Lines are parted by line feeds; those that are blank always stay. Earlier means a smaller key, null keys last,
    or a smaller line number in the document; lines of equal keys and numbers (repeated rows) do not drop one another.
    A null text stays null and has no lines; a text whose lines all go is empty, or what blank lines it has. Columns
    that are named like the two new ones are replaced; all others stay as they are.
    """
    own = docs.drop("n_lines", "n_dropped")
    return shielded(own, {"_hash", "_key", "_doc", "_gone"} - {key, text}, lambda d: _deduplicated(d, key, text, min_chars))


def _deduplicated(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    lines = lines_of(docs, key, text)
    length = F.length("line")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min("pos").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.first(length).cast("int").alias("length"),
        *[F.first(F.when(length >= min_chars, half)).alias(name) for name, half in _anchors(F.col("line"), length).items()],
    )
    distinct = written(distinct, "lines")
    late = settled(alike(lines, distinct, min_chars)).withColumn("late", F.lit(True))
    several = distinct.select("h1", "h2", "first", "n").join(late, ["h1", "h2"], "left").where("late or n > 1").drop("n")
    gone = (
        lines.select("pos", "doc", "h1", "h2")
        .join(several, ["h1", "h2"])
        .where(F.coalesce("late", F.lit(False)) | (F.col("pos") > F.col("first")))
        .groupBy(F.col("pos.key").alias("_key"), F.col("doc").alias("_doc"))
        .agg(F.collect_set("pos.no").alias("_gone"))
    )
    parts = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: parts[i]), "\n")
    rows = docs.withColumn("_hash", F.xxhash64(text))
    joined = rows.join(gone, rows[key].eqNullSafe(gone["_key"]) & (rows["_hash"] == gone["_doc"]), "left")
    columns = [F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else rows[c] for c in docs.columns]
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines")
    return joined.select(*columns, n_lines, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
