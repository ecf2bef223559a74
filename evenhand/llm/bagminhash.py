"""Near-duplicate documents by BagMinHash signatures.

A text is a multiset of word shingles; the similarity of two texts is the weighted Jaccard of their multisets.
A shingle's weight is cut into dyadic levels [0,1), [1,2), [2,4), ...; each level carries a Poisson process whose
rate is its width, whose points fall into a slot and a height of the level, and count when the height lies below
the shingle's weight. A slot's value is its first point, so two texts agree in a slot with a chance of just their
similarity. Points are made in order of time and only while they can still be the first of a slot.

Signatures are banded. Members of a bucket are compared with its leader, not with each other: the member that meets
the most others over all its buckets, as the least changed copy of a group does. Those linked form components. What
shares a bucket that still holds several components is compared by its multisets: two texts of the wanted similarity
share one of their rarest shingles, and what follows the first shared one in both bounds their overlap. Only pairs
that pass this exact bound are verified, again with leaders and in rounds, until no shingle holds two components.
Every link is verified with the true multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import freed, packed, settled, shielded, written
from evenhand.llm.graph import components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
WORDS_HELD = 250_000
#: Members that one copy of a leader's text is compared with.
MEMBERS_PER_LEADER = 200
#: Pairs, or texts where these are more, that one partition verifies.
VERIFIED_AT_ONCE = 2_000
#: Leaders of a bucket in the first of the later rounds; every further round has twice as many.
LEADERS = 16
#: Counters that order shingles by how often they occur; fewer order them less well, with the same result.
SLOTS = 1 << 18
_HIGH = np.uint64(64 - 10)
DOCS_AT_ONCE = 1 << 10


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Weighted shingles of texts, with a bounded table of word hashes."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.words: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        fresh = set(words).difference(self.words)
        if len(self.words) + len(fresh) > WORDS_HELD:
            self.words.clear()
            fresh = set(words)
        for w in fresh:
            self.words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def bags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, shingle, weight) of up to ``DOCS_AT_ONCE`` texts, by text and shingle.

        A text of fewer words than a shingle has is one shingle; a text without words has none.
        """
        hashes, owners = [], []
        for k, text in enumerate(texts):
            words = text.lower().split()
            if not words:
                continue
            h = self._hashes(words)
            n = max(1, len(h) - self.width + 1)
            s = np.zeros(n, np.uint64)
            for j in range(min(self.width, len(h))):
                s = (s ^ h[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
                s ^= s >> np.uint64(29)
            hashes.append(s)
            owners.append(np.full(n, k, np.uint64))
        if not hashes:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key = np.sort((np.concatenate(owners) << _HIGH) | (mixed(np.concatenate(hashes)) >> np.uint64(10)))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight = np.diff(np.append(first, len(key)))
        key = key[first]
        return (key >> _HIGH).astype(np.int64), key & np.uint64((1 << 54) - 1), weight


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """(texts, slots) values; texts without shingles keep the largest value in every slot."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(texts * slots, top)
    # a process for every level that the weight reaches into
    reach = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(owner)), reach)
    level = np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.maximum(low, 1)
    doc, limit = owner[at], weight[at]
    seed = mixed(shingle[at] ^ mixed(level.astype(np.uint64)))
    time = np.zeros(len(at))
    point = 0
    while len(seed):
        point += 1
        r = mixed(seed + np.uint64(point * 0xD6E8FEB86659FD93 % 2**64))
        time = time - np.log(((r >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / width
        place = mixed(r ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        slot = (place % np.uint64(slots)).astype(np.int64)
        height = low + width * ((place >> np.uint64(40)).astype(np.float64) * 2.0**-24)
        on = np.floor(height) < limit
        stamp = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
        np.minimum.at(values, doc[on] * slots + slot[on], stamp[on])
        latest = values.reshape(texts, slots).max(axis=1)
        bound = np.where(latest == top, np.inf, (latest >> np.uint64(32)).astype(np.uint32).view(np.float32))
        go = time <= bound[doc]
        seed, time, width, low, doc, limit = seed[go], time[go], width[go], low[go], doc[go], limit[go]
    return values.reshape(texts, slots)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hashes of the bands."""
    x = values[:, : bands * rows].reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), x.shape[:2]).copy()
    for j in range(rows):
        key = mixed(key ^ x[:, :, j])
    return key.view(np.int64)


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (shingles ascending, weights); 0 if either is empty."""
    total = one[1].sum() + other[1].sum()
    if not len(one[0]) or not len(other[0]):
        return 0.0
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    common = np.minimum(one[1][i], other[1][j]).sum()
    return float(common / (total - common))


def banded(texts: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, bands) of (node, text); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                owner, keys, weight = shingler.bags([t or "" for t in part.column(1).to_pylist()])
                on = np.unique(owner)
                if len(on):
                    keys = band_keys(signatures(owner, keys, weight, part.num_rows, bands * rows)[on], bands, rows)
                    offsets = pa.array(np.arange(len(on) + 1, dtype=np.int32) * bands)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), lists], names=["node", "bands"])

    return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int, rows_at_most: int) -> DataFrame:
    """(a, b, linked) for pairs (member a, leader b).

    A leader's text travels once for every ``MEMBERS_PER_LEADER`` members, so neither a leader with very many
    members nor its text's copies gather in one task. ``rows_at_most``, the number of pairs or of texts, whichever
    is larger, sets the number of partitions.
    """
    parts = rows_at_most // VERIFIED_AT_ONCE + 1
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_LEADER).cast("int").alias("salts"))
    salted = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    leaders = salted.select("b", "salt").distinct()
    wanted = salted.select(F.col("a").alias("id"), "b", "salt", F.lit(1).alias("role")).union(
        leaders.select(F.col("b").alias("id"), "b", "salt", F.lit(0).alias("role"))
    )
    rows = texts.select(F.col("node").alias("id"), "text").repartition(parts, "id").join(wanted.repartition(parts, "id"), "id")
    rows = rows.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, leader, bag = Shingler(shingle), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                owner, keys, weight = shingler.bags([t or "" for t in part.column(1).to_pylist()])
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                a, b, on = [], [], []
                for k, (node, lead, role) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    own = (keys[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]])
                    if role == 0:
                        leader, bag = lead, own
                        continue
                    if lead != leader:
                        raise ValueError("a leader's text is missing")
                    a.append(node)
                    b.append(lead)
                    on.append(similarity(own, bag) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(on, pa.bool_())], names=["a", "b", "linked"])

    return rows.mapInArrow(run, "a binary, b binary, linked boolean")


def rarest(texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(bucket, node, size, rest) for the rarest shingles of every (node, text).

    ``bucket`` is the shingle, ``size`` the weight of all shingles of the text, ``rest`` that of this one and of those
    that follow it in one order for all texts, rare ones first. A shingle counts while ``rest`` is at least the
    threshold's share of ``size``: what two texts of that similarity have in common starts no later in either of them.
    Shingles of a single text are left out. The order comes from ``SLOTS`` counters, the only thing that is broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, n = Shingler(shingle), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                _, keys, _ = shingler.bags(batch.slice(start, DOCS_AT_ONCE).column(1).to_pylist())
                n += np.bincount((keys % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[on])], names=["slot", "n"])

    spark = texts.sparkSession
    texts = texts.select("node", "text")
    counted = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(SLOTS, np.int64)
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often = Shingler(shingle), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                owner, keys, weight = shingler.bags(part.column(1).to_pylist())
                if not len(owner):
                    continue
                n = often[(keys % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((keys, n, owner))
                keys, weight, n = keys[order], weight[order], n[order]
                before = np.cumsum(weight) - weight
                first = np.searchsorted(owner, np.arange(part.num_rows))
                size = np.bincount(owner, weights=weight, minlength=part.num_rows).astype(np.int64)[owner]
                rest = size - (before - before[first[owner]])
                on = (rest >= threshold * size - 1e-9) & (n > 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[on].view(np.int64)), part.column(0).take(pa.array(owner[on])), pa.array(size[on]), pa.array(rest[on])],
                    names=["bucket", "node", "size", "rest"],
                )

    return texts.mapInArrow(run, "bucket long, node binary, size long, rest long")


def _several(members: DataFrame, threshold: float) -> DataFrame:
    """Of (bucket, node, size, rest, component) the members that can be alike to one of another component in their bucket."""
    for _ in range(2):
        least = members.groupBy("bucket").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("size").alias("least"), F.max("rest").alias("most")
        )
        members = members.join(least.where("lo <> hi").drop("lo", "hi"), "bucket")
        possible = F.least("rest", "most") * (1 + threshold) >= threshold * (F.col("size") + F.col("least")) - 1e-9
        members = members.where(possible).drop("least", "most")
    return members


def _linked(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) links and the (node, component) that they make."""
    keys = banded(docs, shingle, bands, rows).dropDuplicates(["node"])
    exploded = keys.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    exploded = written(exploded, "bands")
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(exploded.join(shared, "bucket").select("bucket", "node", "n"), "buckets")
    freed(exploded)
    n_members = members.count()
    members = packed(members, n_members)
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    leaders = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("leader"))
    leaders = leaders.select("bucket", F.col("leader.node").alias("leader"))
    texts = written(docs.select("node", "text").dropDuplicates(["node"]).join(central.select("node"), "node", "left_semi"), "texts")
    pairs = members.join(leaders, "bucket").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = settled(packed(pairs, n_members))
    compared = pairs.count()
    known = written(verified(packed(pairs, compared), texts, threshold, shingle, max(compared, texts.count())), "links")
    found = components(known.where("linked"))
    of = lambda table: table.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = of(members).groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    unsettled = members.join(several.select("bucket"), "bucket", "left_semi").select("node").distinct()
    texts = written(texts.join(unsettled, "node", "left_semi"), "open")
    alive = written(rarest(texts, threshold, shingle), "rarest")
    size, n_texts = alive.count(), texts.count()
    alive, at_once = packed(alive, size), LEADERS
    while size:
        marked = settled(packed(_several(of(alive), threshold), size))
        size = marked.count()
        if not size:
            break
        marked = packed(marked, size)
        # the members of a bucket's smallest components lead next; each leads once
        sizes = marked.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size", "rest")).alias("first"))
        order = Window.partitionBy("bucket").orderBy("n", "component")
        leaders = (
            sizes.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= at_once)
            .select("bucket", F.col("first.node").alias("leader"), F.col("component").alias("own"), F.col("first.size").alias("of"), F.col("first.rest").alias("left"))
        )
        possible = F.least("rest", "left") * (1 + threshold) >= threshold * (F.col("size") + F.col("of")) - 1e-9
        candidates = (
            marked.join(leaders, "bucket")
            .where((F.col("component") != F.col("own")) & possible)
            .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b"))
            .distinct()
        )
        seen = packed(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), compared)
        fresh = settled(packed(candidates.join(seen, ["a", "b"], "left_anti"), size + compared))
        n_fresh = fresh.count()
        if n_fresh:
            more = settled(verified(packed(fresh, n_fresh), texts, threshold, shingle, max(n_fresh, n_texts)))
            known, compared = known.union(more), compared + n_fresh
            if not more.where("linked").isEmpty():
                # a component stands for the links that made it
                found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.where("linked").select("a", "b")))
        led = leaders.select("bucket", F.col("leader").alias("node"))
        alive = settled(packed(marked.drop("component").join(led, ["bucket", "node"], "left_anti"), size))
        at_once *= 2
    return known.where("linked").select("a", "b"), found


def links(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b) verified links between different texts (node, text) that join all near-duplicates found by the bands.

    Rows with equal texts are one node. Texts are shuffled once: of those that share a bucket with another one.
    """
    return _linked(docs, threshold, shingle, bands, rows)[0]


def grouped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE
) -> DataFrame:
    """(key, node, class_id, n_class, kept): one row per document with its class.

    Equal texts share a class, null counting as the empty text; otherwise classes are the components of links of
    similarity at least ``threshold``. ``class_id`` is the least key of the class, ``kept`` marks the document that
    stays: the one with that key, and of several with that key the one with the least ``node`` (MD5 of the text).
    Null keys come last. Repeated rows stay rows; an empty table gives no rows; other columns are left out.
    """
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("node", F.unhex(F.md5("text")))
    _, found = _linked(own, threshold, shingle, BANDS, ROWS)
    rows = own.select("_key", "node")
    marked = rows.join(found, "node", "left").select("_key", "node", F.coalesce("component", "node").alias("component"))
    least = marked.groupBy("component").agg(
        F.min(F.struct(F.isnull("_key").alias("last"), F.col("_key").alias("key"), F.col("node").alias("node"))).alias("winner"),
        F.count(F.lit(1)).alias("n_class"),
    )
    return marked.join(least, "component").select(
        F.col("_key").alias(key),
        "node",
        F.col("winner.key").alias("class_id"),
        "n_class",
        (F.col("winner.key").eqNullSafe(F.col("_key")) & (F.col("winner.node") == F.col("node"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without near-duplicates: of each class the kept one, of its repeated rows one; all columns."""
    return shielded(docs, {"_key", "_winner", "_hash", "_node"} - {key, text}, lambda d: _deduplicated(d, key, text, **options))


def _deduplicated(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    winners = grouped(docs, key, text, **options).where("kept").select(F.col(key).alias("_key"), F.col("node").alias("_winner")).distinct()
    winners = winners.withColumn("_hash", F.xxhash64("_key", "_winner"))
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    marked = docs.withColumn("_node", node).withColumn("_hash", F.xxhash64(F.col(key), F.col("_node")))
    same = (marked["_hash"] == winners["_hash"]) & marked[key].eqNullSafe(winners["_key"]) & (marked["_node"] == winners["_winner"])
    # rows are dealt by the hash, for the join and for the repeated rows alike
    return marked.join(winners, same, "left_semi").dropDuplicates(["_hash", key, "_node"]).drop("_node", "_hash")
