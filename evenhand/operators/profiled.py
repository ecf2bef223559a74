"""Logistic regression with a weight for every value of a wide column, without a dense vector of all weights.

The penalised loss is minimised by Newton steps over the shared weights (intercept and all other features). The weight of
a value meets only the rows with that value: for given shared weights it is the root of one increasing function, found
where those rows lie, and it enters the shared step through its share of the Hessian. So a pass over the rows sends one
small matrix, and the optimum is the one that MLlib's learner approaches. Rows are dealt by ranges of the value's slot and
stored in chunks; a slot that chunks share (one at most for every cut, however many rows it has) is a weight of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.session import scratch_path, settle, shipped

#: Shared weights up to which their matrix is summed as rows; rows of a partition, and of a chunk.
SHARED, PARTITION, CHUNK = 512, 200_000, 100_000
CELLS = 4_000_000
ENOUGH, STEPS = 1e-12, 100


def cells(k: int) -> int:
    """Rows of a chunk whose matrix of ``k`` columns is held at once."""
    return max(1_024, min(CHUNK, CELLS // k))


def squash(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, e) / (1.0 + e)


class Chunk:
    """Rows in the order of their slots: ``y``, ``x`` (dense, first column 1), the distinct slots and where each starts."""

    def __init__(self, row: dict, k: int):
        self.y = np.frombuffer(row["y"], np.float64)
        slot = np.frombuffer(row["slot"], np.int64)
        self.starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        self.slots = slot[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(slot)))
        self.x = np.zeros((len(slot), k))
        self.x[:, 0] = 1.0
        lengths, at = np.frombuffer(row["lengths"], np.int32), np.frombuffer(row["at"], np.int32)
        self.x[np.repeat(np.arange(len(slot)), lengths), at + 1] = np.frombuffer(row["value"], np.float64)

    def solved(self, theta: np.ndarray, shared: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins without the slots' weights, weights of the slots, which of them were found here)."""
        z = self.x @ theta
        free = np.array([s >= 0 and s not in shared for s in self.slots.tolist()], bool)
        u = np.array([shared.get(s, 0.0) for s in self.slots.tolist()])
        ones = np.add.reduceat(self.y, self.starts)
        u[free] = roots(z[np.repeat(free, self.sizes)], self.sizes[free], ones[free])
        return z, u, free


def roots(z: np.ndarray, sizes: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """For every run of rows the u with ``sum(squash(z + u)) - ones + u = 0``: Newton, halving where a step leaves the bracket
    or does not halve the one before."""
    u = np.zeros(len(sizes))
    lo, hi = ones - sizes, ones.astype(float)  # u is ones less a sum of probabilities
    last = hi - lo
    on = np.arange(len(sizes))
    while len(on):
        starts = np.append(0, np.cumsum(sizes)[:-1])
        v = u[on]
        p = squash(z + np.repeat(v, sizes))
        f = np.add.reduceat(p, starts) - ones[on] + v
        slope = np.add.reduceat(p * (1 - p), starts) + 1
        lo[on], hi[on] = np.where(f <= 0, v, lo[on]), np.where(f >= 0, v, hi[on])
        step = -f / slope
        halve = (v + step < lo[on]) | (v + step > hi[on]) | (2 * np.abs(step) > last[on])
        step = np.where(halve, (lo[on] + hi[on]) / 2 - v, step)
        last[on] = np.abs(step)
        u[on] = v + step
        stay = np.abs(step) > 1e-13 * (1 + np.abs(v))
        z, sizes, on = z[np.repeat(stay, sizes)], sizes[stay], on[stay]
    return u


def chunks(train: DataFrame, label: str, at: int, size: int, k: int) -> DataFrame:
    """(lo, hi, y, slot, lengths, at, value): the rows of ``train`` by slot, many to a line. The slot is the place of a row's
    entry among the features ``at``…``at + size − 1``, −1 without one; other features keep their order."""
    vector = F.unwrap_udt("features")
    rows = train.select(F.col(label).alias("y"), vector["indices"].alias("i"), vector["values"].alias("v"))
    own = f"element_at(filter(i, e -> e >= {at} AND e < {at + size}), 1)"
    slot = F.expr(f"CAST(coalesce(CASE WHEN size(filter(i, e -> e >= {at} AND e < {at + size})) > 0 THEN {own} - {at} END, -1) AS BIGINT)")
    rows = rows.select("y", slot.alias("slot"), "i", "v", F.rand(11).alias("deal"))
    parts = train.count() // PARTITION + 1
    dealt = rows.repartitionByRange(parts, "slot", "deal").sortWithinPartitions("slot").drop("deal")
    most = cells(k)

    def line(table: pa.Table) -> pa.RecordBatch:
        lengths = table["i"].combine_chunks().value_lengths().to_numpy()
        index, value = table["i"].combine_chunks().flatten().to_numpy(), table["v"].combine_chunks().flatten().to_numpy()
        slot = table["slot"].to_numpy()
        # the dictionary's own entries are the slots; what lies behind them moves up
        other = (index < at) | (index >= at + size)
        row = np.repeat(np.arange(len(slot)), lengths)[other]
        index = np.where(index >= at + size, index - size, index)[other]
        fields = (table["y"].to_numpy(), slot, np.bincount(row, minlength=len(slot)).astype(np.int32), index.astype(np.int32), value[other].astype(float))
        return pa.RecordBatch.from_arrays(
            [pa.array([int(slot[0])]), pa.array([int(slot[-1])]), *(pa.array([f.tobytes()], pa.binary()) for f in fields)],
            names=["lo", "hi", "y", "slot", "lengths", "at", "value"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= most:
                table = pa.Table.from_batches(held)
                slot = table["slot"].to_numpy()
                # whole slots, unless one fills the chunk
                cut = np.flatnonzero(slot[1:most] != slot[: most - 1])
                end = int(cut[-1]) + 1 if len(cut) else most
                yield line(table.slice(0, end))
                table = table.slice(end)
                held, n = table.to_batches(), table.num_rows
        if n:
            yield line(pa.Table.from_batches(held))

    path = scratch_path(train.sparkSession, "chunks")
    dealt.mapInArrow(pack, "lo long, hi long, y binary, slot binary, lengths binary, at binary, value binary").write.parquet(path)
    return train.sparkSession.read.parquet(path)


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({n: batch.column(n)[i].as_buffer() for n in ("y", "slot", "lengths", "at", "value")}, k)


def derivatives(stored: DataFrame, theta: np.ndarray, shared: dict[int, float]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Loss, gradient and matrix (flat) of the shared weights, those of the slots found on the way; and for every slot
    in ``shared`` its gradient, curvature and mixed derivatives. Penalties of shared weights and slots are left out."""
    k = len(theta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, apart = np.zeros(1 + k + k * k), {}
        for c in _each(batches, k):
            z, u, free = c.solved(theta, shared)
            m = z + np.repeat(u, c.sizes)
            p = squash(m)
            error, w = p - c.y, p * (1 - p)
            xw = c.x * w[:, None]
            mixed = np.add.reduceat(xw, c.starts, axis=0)
            slope, curve = np.add.reduceat(error, c.starts), np.add.reduceat(w, c.starts)
            total[0] += (np.logaddexp(0, m) - c.y * m).sum() + (u[free] ** 2).sum() / 2
            total[1 : k + 1] += c.x.T @ error
            matrix = c.x.T @ xw - mixed[free].T @ (mixed[free] / (curve[free] + 1)[:, None])
            total[k + 1 :] += matrix.ravel()
            for s in np.flatnonzero(~free & (c.slots >= 0)).tolist():
                found = np.concatenate([[slope[s], curve[s]], mixed[s]])
                key = int(c.slots[s])
                apart[key] = apart[key] + found if key in apart else found
        for key, x in [(-1, total), *apart.items()]:
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key)), pa.array(at), pa.array(x[at])], names=["slot", "at", "x"])

    sums = stored.mapInArrow(run, "slot long, at long, x double").groupBy("slot", "at").agg(F.sum("x").alias("x")).toArrow()
    slot, at, x = (sums[c].to_numpy() for c in ("slot", "at", "x"))
    total = np.zeros(1 + k + k * k)
    total[at[slot < 0]] = x[slot < 0]
    apart = {s: np.zeros(2 + k) for s in shared}
    for s, a, v in zip(slot[slot >= 0].tolist(), at[slot >= 0].tolist(), x[slot >= 0].tolist(), strict=True):
        apart[s][a] = v
    return total, apart


def fit(train: DataFrame, label: str, at: int, size: int, width: int) -> tuple[float, np.ndarray, DataFrame]:
    """(intercept, weights of the other features, (slot, weight)): the least summed loss plus half the squared weights.

    ``train`` holds a 0/1 label, both of which occur, and sparse vectors ``features`` of ``width`` with the wide column at
    ``at``…``at + size − 1``, at most one entry a row. A slot without rows has no line; its weight is 0.
    """
    spark = train.sparkSession
    shipped(spark)
    k = width - size + 1
    stored = chunks(train, label, at, size, k)
    ends = stored.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("slot")).filter("slot >= 0")
    shared = {r["slot"]: 0.0 for r in ends.groupBy("slot").count().filter("count > 1").collect()}  # one for every cut at most
    theta, penalty = np.zeros(k), np.append(0.0, np.ones(k - 1))

    def evaluated(theta: np.ndarray, shared: dict[int, float]) -> tuple:
        total, apart = derivatives(stored, theta, shared)
        u = np.array(list(shared.values()))
        loss = total[0] + (penalty * theta**2).sum() / 2 + (u**2).sum() / 2
        gradient, matrix = total[1 : k + 1] + penalty * theta, total[k + 1 :].reshape(k, k) + np.diag(penalty)
        own = np.array([apart[s] for s in shared]).reshape(len(shared), k + 2)
        slope, curve, mixed = own[:, 0] + u, own[:, 1] + 1, own[:, 2:]
        step = -np.linalg.solve(matrix - mixed.T @ (mixed / curve[:, None]), gradient - mixed.T @ (slope / curve))
        moved = -(slope + mixed @ step) / curve
        return loss, -(gradient @ step + slope @ moved), step, dict(zip(shared, moved.tolist(), strict=True))

    loss, gain, step, moved = evaluated(theta, shared)
    for _ in range(STEPS):
        if not gain > ENOUGH:
            break
        length = 1.0
        while True:
            there = theta + length * step, {s: u + length * moved[s] for s, u in shared.items()}
            new = evaluated(*there)
            if new[0] <= loss - 1e-4 * length * gain + 1e-12 * abs(loss) or length < 1e-6:
                break
            length /= 2
        (theta, shared), (loss, gain, step, moved) = there, new
    theta, shared = theta + step, {s: u + moved[s] for s, u in shared.items()}

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches, k):
            _, u, free = c.solved(theta, shared)
            yield pa.RecordBatch.from_arrays([pa.array(c.slots[free]), pa.array(u[free])], names=["slot", "weight"])

    found = stored.mapInArrow(weights, "slot long, weight double")
    if shared:
        found = found.unionByName(spark.createDataFrame(pa.table({"slot": pa.array(list(shared), pa.int64()), "weight": pa.array(list(shared.values()), pa.float64())})))
    return float(theta[0]), theta[1:], settle(found)
