"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from vectors that fall on the same side of random hyperplanes. Each round joins the
neighbours of every vector with each other (a neighbour of a neighbour is probably a neighbour) and keeps the
best ``K``. Rounds end when hardly a link is new. The links of the lists make components. Lists leave out what no
group brought together and what is beyond their length, so all vectors are then compared with those of their label,
block by block: every link is counted, and those between components are kept. Links within a component are never rows,
so a large group of near copies costs comparisons and no disk. Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import settled, shipped, written
from evenhand.llm.graph import components
from evenhand.llm.vafile import usable

THRESHOLD, K = 0.98, 8
#: Hyperplane tables of the start, members of a group that is compared at once, joined members of a centre.
TABLES, GROUP, MEMBERS = 8, 24, 256
#: Vectors whose links are counted by brute force for the audit.
AUDITED = 512
#: Components of the vectors of a block, which every task holds, and vectors that are compared with them at once.
BLOCK_VALUES, AT_ONCE = 1 << 19, 512


def nodes_of(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(<key>, node, label, dim, vec) of the vectors that can link: node is the least key of equal vectors."""
    whole = rows.where(usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()).where(F.exists(vector, lambda x: x != 0))
    whole = whole.select(F.col(key), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("vec"))
    least = whole.groupBy("label", "vec").agg(F.min(key).alias("node"))
    return whole.join(least, ["label", "vec"]).select(key, "node", "label", "vec", F.size("vec").alias("dim"))


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    # a tiny or huge vector must not vanish when its components are squared
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _planes(nodes: DataFrame, first: int, tables: int) -> DataFrame:
    """(gid, node): groups of about ``GROUP`` vectors of a label that fall on one side of several hyperplanes."""
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.join(sizes, ["label", "dim"])

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                x = _unit(g["vec"].tolist())
                bits = np.ceil(np.log2(np.maximum(g["n"].to_numpy() / (GROUP // 2), 1))).astype(np.int64)
                for t in range(first, first + tables):
                    normals = np.random.default_rng([t, dim]).standard_normal((dim, 40))
                    sides = (x @ normals > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))
                    yield pd.DataFrame({"node": g["node"], "t": t, "label": g["label"].astype(str), "side": sides >> (40 - np.minimum(bits, 40)), "dim": dim})

    fallen = rows.select("node", "label", "dim", "n", "vec").mapInPandas(keys, "node long, t int, label string, side long, dim int")
    fallen = fallen.select("node", "t", F.xxhash64("t", "label", "dim", "side").alias("bucket"))
    fallen = settled(fallen)
    # a bucket beyond a group's size is dealt out at random; the rounds bring its parts together
    parts = fallen.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    return fallen.join(parts, "bucket").select(F.xxhash64("bucket", F.pmod(F.xxhash64("node", "t"), F.col("parts"))).alias("gid"), "node")


def _pairs(members: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(u, v, sim): within every group (gid, node, fresh) each member's k best partners, ties to the lesser node.

    Only pairs with a fresh member count. Groups stream through the tasks one after the other.
    """
    rows = members.join(nodes.where(F.col("node") == F.col("own")).select("node", "label", "vec"), "node")
    rows = rows.repartition("gid").sortWithinPartitions("gid")

    def compare(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2 or not g["fresh"].any() or len(g["vec"].iloc[0]) != len(g["vec"].iloc[-1]):
            return None
        g = g.sort_values("node")
        node, fresh = g["node"].to_numpy(), g["fresh"].to_numpy()
        x = _unit(g["vec"].tolist())
        sim = x @ x.T
        sim[~(fresh[:, None] | fresh[None, :])] = -np.inf
        np.fill_diagonal(sim, -np.inf)
        v = np.argsort(-sim, axis=1, kind="stable")[:, : min(k, len(g) - 1)].ravel()
        u = np.repeat(np.arange(len(g)), min(k, len(g) - 1))
        on = np.isfinite(sim[u, v])
        return pd.DataFrame({"u": node[u[on]], "v": node[v[on]], "sim": sim[u[on], v[on]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            gid = f["gid"].to_numpy()
            cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                out = compare(f.iloc[a:b])
                if out is not None:
                    yield out
            held = f.iloc[cuts[-1] :]
        if held is not None:
            out = compare(held)
            if out is not None:
                yield out

    return rows.select("gid", "node", "fresh", "vec").mapInPandas(run, "u long, v long, sim double")


def _best(lists: DataFrame | None, pairs: DataFrame, k: int) -> DataFrame:
    """(u, v, sim, fresh): the k best of every u."""
    both = pairs.select("u", "v", "sim", F.lit(1).alias("fresh")).union(pairs.select("v", "u", "sim", F.lit(1)))
    if lists is not None:
        both = both.union(lists.select("u", "v", "sim", F.lit(0)))
    merged = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return settled(merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"))


def _centres(lists: DataFrame, turn: int) -> DataFrame:
    """(gid, node, fresh): every vector with the neighbours in both directions, as a group to be joined.

    A centre joins ``MEMBERS`` of its neighbours at most in one round, drawn anew each round. Where lists are long,
    as many centres are drawn as give a few new pairs for every entry: what one leaves out others bring.
    """
    # a new entry may also bring a vector to its neighbour's centre
    around = lists.select(F.col("u").alias("gid"), F.col("v").alias("node"), "fresh").union(lists.select("v", "u", "fresh"))
    around = around.groupBy("gid", "node").agg(F.max("fresh").alias("fresh"))
    sizes = around.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any"))
    chance = F.least(F.lit(1.0), 6.0 * F.col("n") / F.least(F.col("n"), F.lit(MEMBERS)) ** 2 + F.when(F.col("n") <= 4 * K, 1).otherwise(0))
    share = lambda *x: F.pmod(F.xxhash64(F.lit(turn), *x), F.lit(1 << 20)) / (1 << 20)
    drawn = sizes.where((F.col("any") == 1) & (share("gid") < chance))
    joined = around.join(drawn.select("gid", "n"), "gid").where(share("node", "gid") < MEMBERS / F.col("n"))
    centre = drawn.select("gid", F.col("gid").alias("node"), F.lit(0).alias("fresh"))
    return joined.select("gid", "node", "fresh").union(centre)


def audit(lists: DataFrame, nodes: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """The share of a sample's links, found by brute force, that the lists hold; 1 if the sample has no link.

    The sample is a fixed number of vectors, those with the least hashes.
    """
    spark = nodes.sparkSession
    drawn = nodes.where(F.col("node") == F.col("own")).select("node", "label", "vec", F.xxhash64("node").alias("h")).orderBy("h").limit(sample).drop("h")
    asked = drawn.toPandas()
    shared = spark.sparkContext.broadcast(asked)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = shared.value
        for f in frames:
            for (label, dim), g in f.groupby(["label", "dim"]):
                q = ask[(ask["label"] == label) & (ask["vec"].map(len) == dim)]
                if len(q):
                    i, j = np.nonzero(_unit(q["vec"].tolist()) @ _unit(g["vec"].tolist()).T >= threshold)
                    u, v = q["node"].to_numpy()[i], g["node"].to_numpy()[j]
                    yield pd.DataFrame({"u": u[u != v], "v": v[u != v]})

    truth = nodes.where(F.col("node") == F.col("own")).select("node", "label", "dim", "vec").mapInPandas(count, "u long, v long")
    known = lists.select("u", "v", F.lit(1).alias("known"))
    row = truth.join(known, ["u", "v"], "left").agg(F.count(F.lit(1)).alias("all"), F.count("known").alias("known")).first()
    return row["known"] / row["all"] if row["all"] else 1.0


def _by_block(own: DataFrame, values: int, compare: Callable, schema: str) -> DataFrame:
    """``compare(frames, block, shared)`` over the vectors of a block's own and later blocks, one block after the other.

    A block has about ``values`` components; ``shared`` has its (frame, unit vectors) by label and length. Vectors are
    not copied for other blocks.
    """
    spark = own.sparkSession
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    blocks = max(1, -(-size["n"] * (size["dim"] or 1) // values))
    parts = max(2 * spark.sparkContext.defaultParallelism, size["n"] // 4096)
    own = settled(own.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).repartition(parts, "node"))
    out = None
    for block in range(blocks):
        asked = own.where(F.col("block") == block).toPandas()
        shared = spark.sparkContext.broadcast({x: (g.drop(columns="vec"), _unit(g["vec"].tolist())) for x, g in asked.groupby(["label", "dim"])})
        task = lambda frames, shared=shared, block=block: compare(frames, block, shared.value)
        found = settled(own.where(F.col("block") >= block).mapInPandas(task, schema))
        shared.destroy()
        out = found if out is None else out.union(found)
    return out


def _once(frames: Iterator[pd.DataFrame], block: int, shared: dict, threshold: float) -> Iterator[tuple]:
    """(label and length, some vectors, i, j): places of the links between some vectors and the block's, each link once."""
    for f in frames:
        for x, g in f.groupby(["label", "dim"]):
            if x not in shared:
                continue
            ask, q = shared[x]
            for at in range(0, len(g), AT_ONCE):
                some = g.iloc[at : at + AT_ONCE]
                i, j = np.nonzero(_unit(some["vec"].tolist()) @ q.T >= threshold)
                on = (some["block"].to_numpy()[i] > block) | (some["node"].to_numpy()[i] > ask["node"].to_numpy()[j])
                yield x, some, i[on], j[on]


def _comparable(nodes: DataFrame, *columns: str) -> DataFrame:
    own = nodes.where(F.col("node") == F.col("own"))
    return own.select("node", F.col("label").cast("string").alias("label"), "dim", "vec", *columns).dropDuplicates(["node"])


def block_links(nodes: DataFrame, threshold: float, values: int = BLOCK_VALUES) -> DataFrame:
    """(u, v), both directions, of all links between different vectors, as rows."""

    def compare(frames: Iterator[pd.DataFrame], block: int, shared: dict) -> Iterator[pd.DataFrame]:
        for x, some, i, j in _once(frames, block, shared, threshold):
            yield pd.DataFrame({"u": some["node"].to_numpy()[i], "v": shared[x][0]["node"].to_numpy()[j]})

    out = _by_block(_comparable(nodes), values, compare, "u long, v long")
    return out.union(out.select("v", "u"))


def block_sums(nodes: DataFrame, threshold: float, values: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, others), the copies of all vectors that link with a node, and (u, v) links between different components.

    ``nodes`` also has ``copies`` and ``component``. Of the links that a batch finds between two components one is a row,
    and a task hands on one sum for a vector of the block: rows grow with the vectors, not with the links.
    """

    def compare(frames: Iterator[pd.DataFrame], block: int, shared: dict) -> Iterator[pd.DataFrame]:
        sums = {x: np.zeros(len(ask), np.int64) for x, (ask, _) in shared.items()}
        for x, some, i, j in _once(frames, block, shared, threshold):
            ask = shared[x][0]
            sums[x] += _summed(j, some["copies"].to_numpy()[i], len(ask))
            own = _summed(i, ask["copies"].to_numpy()[j], len(some))
            yield pd.DataFrame({"u": some["node"].to_numpy()[own > 0], "v": some["node"].to_numpy()[own > 0], "n": own[own > 0]})
            one, other = some["component"].to_numpy()[i], ask["component"].to_numpy()[j]
            apart = np.flatnonzero(one != other)
            if len(apart):
                ends = np.unique(np.stack([one[apart], other[apart]]), axis=1)
                yield pd.DataFrame({"u": ends[0], "v": ends[1], "n": 0})
        for x, n in sums.items():
            node = shared[x][0]["node"].to_numpy()[n > 0]
            yield pd.DataFrame({"u": node, "v": node, "n": n[n > 0]})

    out = _by_block(_comparable(nodes, "copies", "component"), values or BLOCK_VALUES, compare, "u long, v long, n long")
    sums = out.where("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    return sums, out.where("n = 0").select("u", "v").distinct()


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def descent(nodes: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(u, v), both directions, of the links between different vectors in the lists of the rounds."""
    known = -1
    groups = _planes(nodes.where(F.col("node") == F.col("own")), 0, TABLES).withColumn("fresh", F.lit(1))
    lists = _best(None, _pairs(groups, nodes, k), k)
    for turn in range(1, 21):
        lists = _best(lists, _pairs(_centres(lists, turn), nodes, k), k)
        before, known = known, lists.where(F.col("sim") >= threshold).count()
        if known <= before * 1.002:
            break
    links = lists.where(F.col("sim") >= threshold)
    return links.select("u", "v").union(links.select("v", "u")).distinct()


def neighbour_links(nodes: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """(u, v), both directions, of all links between different vectors: those of the rounds, and what they left out."""
    return descent(nodes, threshold, k).union(block_links(nodes, threshold)).distinct()


def grouped(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, k: int = K
) -> DataFrame:
    """(<key>, n_links, component_id, kept): one row per vector.

    Vectors of one label link when their cosine is at least ``threshold``. Null and zero vectors, those with null or
    non-finite components, and rows without a label or key link with nothing and are their own component. Vectors of
    different lengths do not link. Equal vectors always link; repeated keys are links of each other if their vectors
    are. An empty table gives no rows; other columns are left out.
    """
    spark = rows.sparkSession
    shipped(spark)
    whole = written(nodes_of(rows, key, vector, label).withColumnRenamed(key, "own"), "nodes")
    copies = whole.groupBy("node", "label").agg(F.count(F.lit(1)).alias("copies"))
    # repeated rows are one vector with copies; a second line of it would be a partner of itself
    vectors = whole.where(F.col("node") == F.col("own")).dropDuplicates(["node"])
    found = components(descent(vectors, threshold, k).select(F.col("u").alias("a"), F.col("v").alias("b")))
    marked = vectors.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    weights, missed = block_sums(marked.join(copies, ["node", "label"]), threshold)
    if not missed.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(missed))
    known = (
        whole.select(F.col("own").alias("id"), "node", "label")
        .join(copies, ["node", "label"])
        .join(weights, "node", "left")
        .join(found, "node", "left")
        .select(
            "id",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
        .groupBy("id")
        .agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    out = rows.select(F.col(key).alias("id")).join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
