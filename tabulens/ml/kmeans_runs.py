"""Many k-means runs at once: every iteration of all of them is one scan of the rows.

Rows are packed once into blocks of neighbours, which stay cached.  A block is a tree of boxes down to ``LEAF`` rows, each
with its rows' sum and scatter.  A scan takes every run from the large boxes to the small ones: a box that lies nearer to
one centre than to any other as a whole is added by its sum, and only rows of boxes that a border between centres crosses
are compared themselves (Kanungo et al. 2002).  A task returns one array of sums, so what reaches the driver goes with
tasks, runs, centres and columns, never with rows.  Runs whose centres stand still are retired.  A k-means++ draw, weighted
by squared distance, is a race of exponential times, whose winner is a minimum that tasks can merge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.ml.kmeans_seeds import parallel_centres
from tabulens.session import written_table

#: Numbers of a packed block at most (8 bytes each), and its rows at least where there are so many.
BLOCK, LEAST_ROWS = 1 << 20, 4096
#: Rows of the smallest boxes, and boxes of a box.
LEAF, FAN = 16, 16
#: Rows, for the borders between blocks.
SAMPLED = 1 << 16
#: Numbers of cached blocks a task.
TASK = 1 << 23
#: Share of the numbers compared that may be rounding; a box that is nearer by less is not added as a whole.
SLACK = 1e-10
#: Rows times centres that a task compares at once (8 bytes each): they stay in the processor's cache.
COMPARED = 100_000


def numbered(features: DataFrame) -> DataFrame:
    """(part, start, rows, data): the vectors as matrices of float64 in the frame's own partitions and order."""
    def packed(batches):
        from pyspark import TaskContext
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = batch.column(0)
            if not len(x):
                continue
            m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            if not np.isfinite(m).all():
                raise ValueError("k-means takes no NaN or infinite values")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "start": pa.array([start], pa.int64()),
                                              "rows": pa.array([len(m)], pa.int32()),
                                              "data": pa.array([np.ascontiguousarray(m, dtype=float).tobytes()], pa.binary())})
            start += len(m)

    return written_table(features.select(vector_to_array("features").alias("x")).mapInArrow(
        packed, "part int, start long, rows int, data binary"))


def shape(rows: DataFrame) -> tuple[int, int]:
    """(rows, columns) of numbered rows."""
    r = rows.agg(F.sum("rows").alias("n"), F.max(F.length("data") / F.col("rows")).alias("bytes")).first()
    return r["n"] or 0, int((r["bytes"] or 0) // 8)


def borders(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values that halve a sample ``depth`` times, each part along its widest column."""
    column, value = np.zeros(2 ** depth - 1, dtype=int), np.full(2 ** depth - 1, np.inf)
    parts = {0: sample}
    for node in range(2 ** depth - 1):
        x = parts.pop(node)
        if len(x):
            column[node] = (x.max(0) - x.min(0)).argmax()
            value[node] = np.median(x[:, column[node]])
        right = x[:, column[node]] > value[node]
        parts[2 * node + 1], parts[2 * node + 2] = x[~right], x[right]
    return column, value


def neighbours(m: np.ndarray) -> np.ndarray:
    """An order of the rows in which every aligned run of ``LEAF`` x 2^i of them lies in a box of its own."""
    n, levels = len(m), max(math.ceil(math.log2(max(len(m) / LEAF, 1))), 0)
    order = np.arange(LEAF << levels)
    padded = np.vstack([m, np.repeat(m[:1], len(order) - n, axis=0)])       # what is added stays behind the rows
    for level in range(levels):
        cells = order.reshape(1 << level, -1)
        x = padded[cells]
        widest = (x.max(1) - x.min(1)).argmax(1)
        key = np.take_along_axis(x, widest[:, None, None], 2)[:, :, 0]
        key[cells >= n] = np.inf
        order = np.take_along_axis(cells, key.argsort(1, kind="stable"), 1).ravel()
    return order[:n]


def boxes(m: np.ndarray) -> np.ndarray:
    """(lowest and highest values, sums, scatter) x smallest boxes of rows in the order of :func:`neighbours`."""
    n, d = m.shape
    leaves = 1 << max(math.ceil(math.log2(max(n / LEAF, 1))), 0)
    x = np.full((leaves * LEAF, d), np.nan)
    x[:n] = m
    x = x.reshape(leaves, LEAF, d)
    some = np.clip(n - LEAF * np.arange(leaves), 0, LEAF)[:, None]
    total = np.nansum(x, axis=1)
    gap = x - (total / np.maximum(some, 1))[:, None]
    low, high = np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1)
    low, high = np.where(some > 0, low, np.inf), np.where(some > 0, high, -np.inf)
    return np.vstack([low.T, high.T, total.T, np.nansum(gap * gap, axis=(1, 2))[None]])


def pack(features: DataFrame) -> DataFrame:
    """(block, rows, data, cells): the vectors of a frame as blocks of neighbours."""
    return blocks_of(numbered(features))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(block, rows, data, cells) of numbered rows: blocks of neighbours in order, and their smallest boxes.

    A bounded sample gives the borders between blocks; how good they are decides about time only.
    """
    n, d = shape(rows)
    d = max(d, 1)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most = max(BLOCK // d, 1)
    depth = max(math.ceil(math.log2(max(n / min(most, max(n // (2 * cores), LEAST_ROWS)), 1))), 0)
    every = max(n // SAMPLED, 1)

    def sampled(batches):
        for batch in batches:
            for start, count, data in zip(batch.column("start"), batch.column("rows"), batch.column("data")):
                m = np.frombuffer(data.as_buffer()).reshape(count.as_py(), -1)[-start.as_py() % every::every]
                yield pa.RecordBatch.from_pydict({"data": pa.array([m.tobytes()], pa.binary())})

    sample = [np.frombuffer(bytes(r["data"])).reshape(-1, d) for r in rows.mapInArrow(sampled, "data binary").collect()] \
        if depth else []
    column, value = borders(np.vstack(sample) if sample else np.empty((0, d)), depth)

    def dealt(batches):
        for batch in batches:
            for part, start, count, data in zip(*(batch.column(c) for c in ("part", "start", "rows", "data"))):
                m = np.frombuffer(data.as_buffer()).reshape(count.as_py(), -1)
                at = np.zeros(len(m), dtype=int)
                for _ in range(depth):
                    at = 2 * at + 1 + (m[np.arange(len(m)), column[at]] > value[at])
                order = at.argsort(kind="stable")
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                pieces = [m[own] for own in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_pydict({
                    "area": pa.array(at[order][cuts], pa.int32()), "part": pa.array([part.as_py()] * len(pieces), pa.int32()),
                    "start": pa.array([start.as_py()] * len(pieces), pa.int64()),
                    "rows": pa.array([len(p) for p in pieces], pa.int32()),
                    "data": pa.array([p.tobytes() for p in pieces], pa.binary())})

    def gathered(batches):
        held, area, count = [], None, 0

        def block():
            m = np.vstack(held)
            m = m[neighbours(m)]
            return pa.RecordBatch.from_pydict({
                "rows": pa.array([len(m)], pa.int32()), "data": pa.array([m.tobytes()], pa.binary()),
                "cells": pa.array([boxes(m).tobytes()], pa.binary())})

        for batch in batches:
            for own, rows_, data in zip(batch.column("area"), batch.column("rows"), batch.column("data")):
                own, whole = own.as_py(), np.frombuffer(data.as_buffer()).reshape(rows_.as_py(), -1)
                for m in (whole[lo:lo + most] for lo in range(0, len(whole), most)):
                    if held and (own != area or count + len(m) > most):
                        yield block()
                        held, count = [], 0
                    area, count = own, count + len(m)
                    held.append(m.copy())
        if held:
            yield block()

    pieces = rows.mapInArrow(dealt, "area int, part int, start long, rows int, data binary")
    tasks = max(min(cores, 2 ** depth), n * d // TASK, 1)
    blocks = pieces.repartition(tasks, "area").sortWithinPartitions("area", "part", "start").mapInArrow(
        gathered, "rows int, data binary, cells binary")
    return written_table(blocks.withColumn("block", F.monotonically_increasing_id()))


def spread(blocks: DataFrame) -> RDD:
    """(data, cells) of the blocks, cached and dealt evenly, a few dozen megabytes a task, each task's in order.

    Every iteration reads them again; bytes kept as Python wrote them come back three times as fast as those of a table.
    """
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    size = blocks.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
    dealt = blocks.repartition(cores * max(math.ceil(size / 8 / TASK / cores), 1)).sortWithinPartitions("block")
    return dealt.select("data", "cells").rdd.map(lambda r: (bytes(r["data"]), bytes(r["cells"]))).persist(
        StorageLevel.MEMORY_AND_DISK)


def _assigned(m: np.ndarray, runs: list[np.ndarray]):
    """(first row, rows, [(first run, owners)]) for slices of the rows; runs of one size have to lie side by side.

    Owners are centres x runs x rows: whether the centre is the row's nearest one (the first of equally near ones).
    """
    alike = [j for j in range(len(runs)) if j == 0 or len(runs[j]) != len(runs[j - 1])] + [len(runs)]
    stacks = [np.stack(runs[a:b], axis=1) for a, b in zip(alike, alike[1:])]            # centres x runs x columns
    halves = [0.5 * np.einsum("ijk,ijk->ij", c, c).reshape(-1, 1) for c in stacks]
    step = max(COMPARED // sum(len(r) for r in runs), 1)
    for lo in range(0, len(m), step):
        x = m[lo:lo + step]
        turned, found = np.ascontiguousarray(x.T), []
        for first, c, half in zip(alike, stacks, halves):
            score = (half - c.reshape(-1, c.shape[2]) @ turned).reshape(*c.shape[:2], len(x))
            best = score[0]
            for other in score[1:]:
                best = np.minimum(best, other)
            own = score == best
            if np.count_nonzero(own) != best.size:                      # equally near centres
                own &= np.cumsum(own, axis=0) == 1
            found.append((first, own))
        yield lo, x, found


def _nearest(m: np.ndarray, runs: list[np.ndarray]):
    """(first row, run, nearest centre, squared distance) for slices of the rows; distances from the differences."""
    for lo, x, found in _assigned(m, runs):
        for first, own in found:
            for j, near in enumerate(own.argmax(axis=0), first):
                gap = x - runs[j][near]
                yield lo, j, near, np.einsum("ij,ij->i", gap, gap)


def plus_plus(blocks: DataFrame, k: int, starts: int, seed: int, d: int) -> list[np.ndarray]:
    """``starts`` k-means++ seedings of ``k`` centres each; centre by centre, one scan for all of them."""
    chains = [np.empty((0, d)) for _ in range(starts)]
    for step in range(k):
        def race(batches, chains=chains, step=step):
            best: dict[int, tuple] = {}
            for pdf in batches:
                for block, data in zip(pdf["block"], pdf["data"]):
                    m = np.frombuffer(data).reshape(-1, d)
                    weight = np.ones((len(chains), len(m)))
                    if step:
                        for lo, j, _, gap in _nearest(m, chains):
                            weight[j, lo:lo + len(gap)] = gap
                    for j in range(len(chains)):
                        times = np.random.default_rng([seed, j, step, block]).exponential(size=len(m))
                        with np.errstate(divide="ignore"):
                            times = times / weight[j]
                        i = int(times.argmin())
                        if j not in best or (times[i], block, i) < best[j][0]:
                            best[j] = ((times[i], block, i), m[i].tolist())
            if best:
                yield pd.DataFrame({"run": list(best), "time": [b[0][0] for b in best.values()],
                                    "block": [b[0][1] for b in best.values()], "i": [b[0][2] for b in best.values()],
                                    "x": [b[1] for b in best.values()]})

        drawn = (blocks.select("block", "data").mapInPandas(race, "run int, time double, block long, i int, x array<double>")
                 .groupBy("run").agg(F.min_by("x", F.struct("time", "block", "i")).alias("x")).collect())
        for r in drawn:                                     # a row a start
            chains[r["run"]] = np.vstack([chains[r["run"]], r["x"]])
    return chains


class Boxes:
    """The boxes of a size: middle and half width (columns x boxes), rows, sums, and scatter about their mean."""

    def __init__(self, low, high, count, total, scatter):
        with np.errstate(invalid="ignore"):
            self.mid, self.half = (low + high) / 2, (high - low) / 2
        self.low, self.high, self.count, self.total, self.scatter = low, high, count, total, scatter
        self.mean = total / np.maximum(count, 1)
        self.stats = np.vstack([total, count]).T.copy()

    def wider(self) -> "Boxes":
        """Boxes of ``FAN`` of these."""
        d = len(self.low)
        count = self.count.reshape(-1, FAN).sum(1)
        total = self.total.reshape(d, -1, FAN).sum(2)
        gap = self.mean.reshape(d, -1, FAN) - (total / np.maximum(count, 1))[:, :, None]
        scatter = self.scatter.reshape(-1, FAN).sum(1) + ((gap * gap).sum(0) * self.count.reshape(-1, FAN)).sum(1)
        return Boxes(self.low.reshape(d, -1, FAN).min(2), self.high.reshape(d, -1, FAN).max(2), count, total, scatter)


def _sizes(cells: np.ndarray, n: int) -> list[Boxes]:
    """Boxes of all sizes of a block, the largest first."""
    d = (len(cells) - 1) // 3
    count = np.clip(n - LEAF * np.arange(cells.shape[1]), 0, LEAF).astype(float)
    out = [Boxes(cells[:d], cells[d:2 * d], count, cells[2 * d:3 * d], cells[3 * d])]
    while len(out[0].count) >= FAN * FAN:                   # both are powers of two
        out.insert(0, out[0].wider())
    return out


def _sweep(sums: np.ndarray, m: np.ndarray, sizes: list[Boxes], c: np.ndarray, costs: bool) -> None:
    """Adds to ``sums`` (centres x (sums, rows, squared distances)) what the centres ``c`` own of a block.

    A row belongs to its nearest centre, the first of equally near ones.
    """
    k, d = c.shape
    half = 0.5 * np.einsum("ij,ij->i", c, c)[:, None]
    apart = np.abs(c[:, None] - c[None])
    at = np.arange(len(sizes[0].count))
    for depth, size in enumerate(sizes):
        at = at[size.count[at] > 0]
        crossed = []
        step = max(COMPARED // k, 64)
        for lo in range(0, len(at), step):
            own = at[lo:lo + step]
            mid = size.mid[:, own]
            score = half - c @ mid                          # of the middles: centres x boxes
            near = score.argmin(0)
            score -= score.min(0)
            bound = SLACK * (np.abs(score).max() + np.abs(half).max() + 1)
            whole = np.ones(len(own), dtype=bool)
            for j in range(k):
                mine = np.flatnonzero(near == j)
                if len(mine):
                    # by how much the difference of two scores can change towards a corner
                    clear = score[:, mine] > apart[j] @ size.half[:, own[mine]] + bound
                    clear[j] = True
                    whole[mine] = clear.all(0)
            crossed.append(own[~whole])
            own, near = own[whole], near[whole]
            owned = (near == np.arange(k)[:, None]).astype(float)
            sums[:, :-1] += owned @ size.stats[own]
            if costs:
                gap = size.mean[:, own] - c[near].T
                sums[:, -1] += owned @ (size.scatter[own] + size.count[own] * (gap * gap).sum(0))
        at = np.concatenate(crossed) if crossed else at
        if not len(at):
            return
        fan = FAN if depth + 1 < len(sizes) else LEAF
        at = (at[:, None] * fan + np.arange(fan)).ravel()
    at = at[at < len(m)]
    step = max(COMPARED // k, 64)
    for lo in range(0, len(at), step):
        x = m[at[lo:lo + step]]
        score = half - c @ x.T
        best = score[0]
        for other in score[1:]:
            best = np.minimum(best, other)
        own = score == best
        if np.count_nonzero(own) != best.size:              # equally near centres
            own &= np.cumsum(own, axis=0) == 1
        sums[:, :d] += own.astype(float) @ x
        sums[:, d] += np.count_nonzero(own, axis=1)
        if costs:
            gap = x - c[own.argmax(axis=0)]
            sums[:, -1] += own.astype(float) @ np.einsum("ij,ij->i", gap, gap)


def _scan(blocks: RDD, runs: dict, d: int, costs: bool = False) -> dict:
    """{run: centres x (sums, rows, squared distances if ``costs``)} of one assignment of all rows to every run's centres."""
    ids = list(runs)
    centres = [runs[run] for run in ids]
    at = np.cumsum([0] + [len(c) for c in centres])

    def run(held):
        total = np.zeros((int(at[-1]), d + 2))
        for data, cells in held:
            m = np.frombuffer(data).reshape(-1, d)
            sizes = _sizes(np.frombuffer(cells).reshape(3 * d + 1, -1), len(m))
            for c, lo, hi in zip(centres, at, at[1:]):
                _sweep(total[lo:hi], m, sizes, c, costs)
        yield total.tobytes()

    flat = sum(map(np.frombuffer, blocks.mapPartitions(run).collect()), np.zeros(int(at[-1]) * (d + 2))).reshape(-1, d + 2)
    return {run: flat[lo:hi] for run, lo, hi in zip(ids, at, at[1:])}


def _moved(stat: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The centres' means; a centre without rows stays where it is."""
    rows = stat[:, -2:-1]
    return np.where(rows > 0, stat[:, :-2] / np.maximum(rows, 1), old)


def lloyd(blocks: DataFrame, centres: dict, tol: float = 1e-4, max_iter: int = 300) -> dict:
    """{run: (inertia, centres)} of k-means from the given centres of each run.

    A run ends when no centre moves by more than ``tol`` (or after ``max_iter`` steps); its inertia is that of the last
    assignment.  A centre without rows stays where it is.
    """
    d = next(iter(centres.values())).shape[1]
    moving, done = dict(centres), {}
    blocks = spread(blocks)
    try:
        for step in range(max_iter):
            found = _scan(blocks, moving, d)
            still = {}
            for run, old in moving.items():
                new = _moved(found[run], old)
                if step + 1 < max_iter and ((new - old) ** 2).sum(axis=1).max() > tol * tol:
                    still[run] = new
                else:
                    done[run] = old
            moving = still
            if not moving:
                break
        found = _scan(blocks, done, d, costs=True) if done else {}
    finally:
        blocks.unpersist()
    return {run: (float(found[run][:, -1].sum()), c) for run, c in done.items()}


def parallel_seeds(rows: DataFrame, blocks: DataFrame, runs: list[tuple[int, int]], seed: int, d: int) -> dict:
    """{(k, i): centres} of MLlib's k-means|| with seed ``seed + i`` and its first step, all runs in the same scans."""
    blocks = spread(blocks)
    try:
        centres = parallel_centres(rows, lambda asked: _scan(blocks, asked, d, costs=True), runs, seed)
        return {run: _moved(stat, centres[run]) for run, stat in _scan(blocks, centres, d).items()}
    finally:
        blocks.unpersist()


def least_inertias(features: DataFrame, ks: list[int], seed: int, starts: int, seeding: str = "parallel") -> list[float]:
    """For each k the smallest inertia of k-means from ``starts`` seedings.

    ``seeding`` is ``parallel`` (each run is the one MLlib makes of its seed) or ``plus_plus``: one scan a centre for all
    runs together.  There a start's seeding for a smaller k is the first centres of its longest one (k-means++ adds centres
    one by one).
    """
    return rows_inertias(numbered(features), ks, seed, starts, seeding) if ks else []


def rows_inertias(rows: DataFrame, ks: list[int], seed: int, starts: int, seeding: str = "parallel") -> list[float]:
    """:func:`least_inertias` of numbered rows."""
    if not ks:
        return []
    blocks, (_, d) = blocks_of(rows), shape(rows)
    if seeding == "parallel":
        centres = parallel_seeds(rows, blocks, [(k, i) for k in ks for i in range(starts)], seed, d)
    else:
        chains = plus_plus(blocks, max(ks), starts, seed, d)
        centres = {(k, i): c[:k] for k in ks for i, c in enumerate(chains)}
    done = lloyd(blocks, centres)
    return [min(inertia for (of, _), (inertia, _) in done.items() if of == k) for k in ks]
