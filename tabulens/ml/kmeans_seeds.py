"""MLlib's k-means|| seedings of many runs at once.

Each run gets the centres that ``pyspark.ml.clustering.KMeans`` starts from with the same k and seed on the same rows in the
same partitions, but all runs share their scans: costs and counts come from sweeps over the cells of ``kmeans_runs``, the
draws from one scan a step.  MLlib draws a row if the next number of its partition's generator is below the row's share of
the cost; a row can only be drawn if that number is below the share it has for the first centre alone, so a scan hands on
the few rows of which this is true, and their shares are taken on the driver.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INIT_STEPS = 2                   # MLlib's default
LOCAL_STEPS = 30                 # steps of the k-means among the drawn rows
ARRAY_SEED = 0x3C074A61          # of Scala's MurmurHash3
MASK = (1 << 64) - 1
LANE = 5                         # draws of a lane, as a power of two
LEAST_SHARE, LEAST_NUMBER = 1e-10, 5e-11         # bounds of Spark's samplers


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 (32 bits) of whole words."""
    def turned(x, r):
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at:at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = (turned(h ^ turned(k, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _hashed(seed: int) -> int:
    """State of Spark's XORShiftRandom after seeding."""
    data = (seed & MASK).to_bytes(8, "big")
    low = _murmur(data, ARRAY_SEED)
    return _murmur(data, low) << 32 | low


def _next(state):
    """The state after one step, of an int or an array."""
    state = state ^ (state << 21) & MASK if isinstance(state, int) else state ^ state << np.uint64(21)
    state = state ^ state >> (35 if isinstance(state, int) else np.uint64(35))
    return state ^ (state << 4) & MASK if isinstance(state, int) else state ^ state << np.uint64(4)


@lru_cache(maxsize=None)
def _jump(power: int) -> np.ndarray:
    """2^power draws (two steps each) at once, as a table of bytes: the steps are linear, so bytes add up by XOR."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    columns = _next(_next(bits)) if power == 0 else _jumped(_jumped(bits, power - 1), power - 1)
    table = np.zeros((8, 256), dtype=np.uint64)
    for byte in range(8):
        for bit in range(8):
            table[byte, 1 << bit:2 << bit] = table[byte, :1 << bit] ^ columns[8 * byte + bit]
    return table


def _jumped(states: np.ndarray, power: int) -> np.ndarray:
    table, out = _jump(power), np.zeros_like(states)
    for byte in range(8):
        out ^= table[byte][(states >> np.uint64(8 * byte)) & np.uint64(255)]
    return out


def uniforms(seeds: list[int], start: int, n: int) -> np.ndarray:
    """Draws ``start`` to ``start + n`` of XORShiftRandom(seed).nextDouble(), a line for each seed."""
    states = np.array([[_hashed(seed)] for seed in seeds], dtype=np.uint64)
    for power in range(start.bit_length()):
        if start >> power & 1:
            states = _jumped(states, power)
    power = LANE
    while states.shape[1] << LANE < n:                      # lanes that far apart are stepped side by side
        states = np.concatenate([states, _jumped(states, power)], axis=1)
        power += 1
    out = np.empty((1 << LANE, *states.shape), dtype=np.uint64)
    for i in range(1 << LANE):
        high = _next(states)
        states = _next(high)
        out[i] = ((high & np.uint64((1 << 26) - 1)) << np.uint64(27)) + (states & np.uint64((1 << 27) - 1))
    return out.transpose(1, 2, 0).reshape(len(seeds), -1)[:, :n] * 2.0 ** -53


class _JavaRandom:
    def __init__(self, seed: int):
        self.seed = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.seed = (self.seed * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.seed >> (48 - n)

    def integer(self) -> int:
        return _signed(self.bits(32), 32)

    def long(self) -> int:
        return _signed((self.integer() << 32) + self.integer())

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0 ** -53

    def below(self, bound: int) -> int:
        if bound & (bound - 1) == 0:
            return bound * self.bits(31) >> 31
        while True:
            bits = self.bits(31)
            if bits - bits % bound + bound - 1 < 1 << 31:
                return bits % bound


def local_centres(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of a few weighted points: k-means++, then k-means, as MLlib does it among the drawn rows."""
    rand = _JavaRandom(0)

    def gaps(centre):
        return ((points - centre) ** 2).sum(axis=1)

    def passed(shares, r):
        """How many shares are added up until they reach ``r``."""
        return int(np.searchsorted(np.concatenate([[0.0], np.cumsum(shares)]), r, side="left"))

    r = rand.double() * weights.sum()
    centres = [points[min(passed(weights, r), len(points)) - 1]]
    cost = gaps(centres[0])
    while len(centres) < k:
        at = min(passed(weights * cost, rand.double() * float((cost * weights).sum())), len(points))
        centres.append(points[max(at - 1, 0)])
        cost = np.minimum(cost, gaps(centres[-1]))
    centres, old = np.array(centres), None
    for _ in range(LOCAL_STEPS):
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if old is not None and (near == old).all():
            break
        old, centres = near, centres.copy()
        for j in range(k):
            own = near == j
            count = weights[own].sum()
            centres[j] = (weights[own, None] * points[own]).sum(axis=0) / count if count else points[rand.below(len(points))]
    return centres


def first_place(sizes: dict[int, int], seed: int) -> tuple[int, int]:
    """(partition, place in it) of the row that RDD.takeSample(False, 1, seed) takes from partitions of these sizes."""
    n = sum(sizes.values())
    rand, share = _JavaRandom(seed), 1.0
    if n > 1:
        gamma = -math.log(1e-4) / n
        share = min(1.0, max(LEAST_SHARE, 1 / n + gamma + math.sqrt(gamma * gamma + 2 * gamma / n)))
    taken: list[tuple[int, int]] = []
    while not taken:
        of_parts = _JavaRandom(rand.integer()) if n > 1 else rand
        for part in range(max(sizes) + 1):
            numbers, i, size = _numbers(of_parts.long()) if share < 1 else None, 0, sizes.get(part, 0)
            while i < size:
                if share >= 1:
                    taken.append((part, i))
                elif share > 0.4:
                    if next(numbers) <= share:
                        taken.append((part, i))
                else:
                    i += int(math.log(max(next(numbers), LEAST_NUMBER)) / math.log1p(-share))
                    if i < size:
                        taken.append((part, i))
                i += 1
    for i in range(len(taken) - 1, 0, -1):
        j = rand.below(i + 1)
        taken[i], taken[j] = taken[j], taken[i]
    return taken[0]


def _numbers(seed: int):
    """XORShiftRandom(seed).nextDouble(), one after the other."""
    state = _hashed(seed)
    while True:
        high = _next(state)
        state = _next(high)
        yield (((high & (1 << 26) - 1) << 27) + (state & (1 << 27) - 1)) * 2.0 ** -53


def first_rows(rows: DataFrame, sizes: dict[int, int], seeds: list[int]) -> dict[int, np.ndarray]:
    """{seed: the row that MLlib's seeding begins with}."""
    at = {s: first_place(sizes, _hashed_int(s)) for s in seeds}

    def found(batches, wanted=sorted(set(at.values()))):
        for part, start, m in matrices(batches):
            own = [(p, i) for p, i in wanted if p == part and start <= i < start + len(m)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, _ in own], pa.int32()), "i": pa.array([i for _, i in own], pa.int64()),
                "x": pa.array([m[i - start].tobytes() for _, i in own], pa.binary())})

    near = F.lit(False)
    for p, i in sorted(set(at.values())):
        near |= (F.col("part") == p) & (F.col("start") <= i) & (F.col("start") + F.col("rows") > i)
    got = {(r["part"], r["i"]): np.frombuffer(bytes(r["x"]))
           for r in rows.where(near).mapInArrow(found, "part int, i long, x binary").collect()}
    return {s: got[place] for s, place in at.items()}


def _hashed_int(seed: int) -> int:
    """XORShiftRandom(seed).nextInt()."""
    return _signed(_next(_hashed(seed)), 32)


def _signed(value: int, bits: int = 64) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def matrices(batches):
    """(part, first row, matrix) of the numbered rows in Arrow batches."""
    for batch in batches:
        for part, start, n, data in zip(*(batch.column(c) for c in ("part", "start", "rows", "data"))):
            yield part.as_py(), start.as_py(), np.frombuffer(data.as_buffer()).reshape(n.as_py(), -1)


def drawn_rows(rows: DataFrame, step: int, firsts: dict[int, np.ndarray], factors: dict[int, float]) -> dict[int, list]:
    """{seed: [(number drawn, row)]} in the rows' order, where the number is below factor x squared distance from the first."""
    salted = [_hashed_int(s) ^ (step << 16) for s in firsts]

    def run(batches):
        for part, start, m in matrices(batches):
            out = []
            for u, (s, first) in zip(uniforms([salt ^ part for salt in salted], start, len(m)), firsts.items()):
                gap = m - first
                cost = np.einsum("ij,ij->i", gap, gap)
                out += [(s, part, start + int(i), float(u[i]), m[i].tobytes())
                        for i in np.flatnonzero(u < factors[s] * cost * (1 + 1e-6))]
            seed, parts, places, numbers, data = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({
                "seed": pa.array(seed, pa.int64()), "part": pa.array(parts, pa.int32()), "i": pa.array(places, pa.int64()),
                "u": pa.array(numbers, pa.float64()), "x": pa.array(data, pa.binary())})

    found: dict = {s: [] for s in firsts}
    for r in sorted(rows.mapInArrow(run, "seed long, part int, i long, u double, x binary").collect(),
                    key=lambda r: (r["part"], r["i"])):         # some dozens of rows a seed
        found[r["seed"]].append((r["u"], np.frombuffer(bytes(r["x"]))))
    return found


def parallel_centres(rows: DataFrame, sweep, runs: list[tuple[int, int]], seed: int) -> dict:
    """{(k, i): centres} that MLlib's k-means|| draws with seed ``seed + i``.

    ``rows`` are numbered as MLlib sees them (:func:`kmeans_runs.numbered`); ``sweep(centres)`` gives of every run's centres
    the rows they own and their squared distances.
    """
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("rows").alias("n")).collect()}
    seeds = sorted({seed + i for _, i in runs})
    firsts = first_rows(rows, sizes, seeds)
    centres = {run: firsts[seed + run[1]][None] for run in runs}
    for step in range(INIT_STEPS):
        # before the first draw runs of one seed have the same centre
        asked = centres if step else {s: firsts[s][None] for s in seeds}
        costs = {key: float(stat[:, -1].sum()) for key, stat in sweep(asked).items()}
        whole = {run: costs[run if step else seed + run[1]] for run in runs}
        factors = {s: max((2.0 * k / whole[(k, i)] for k, i in runs if seed + i == s and whole[(k, i)] > 0), default=0.0)
                   for s in seeds}
        drawn = drawn_rows(rows, step, firsts, factors)
        for k, i in runs:
            old = centres[(k, i)]
            if whole[(k, i)] > 0:
                new = [x for u, x in drawn[seed + i] if u < 2.0 * float(((old - x) ** 2).sum(axis=1).min()) * k / whole[(k, i)]]
                centres[(k, i)] = np.vstack([old, *new])
    for run, c in centres.items():
        centres[run] = np.array([list(x) for x in dict.fromkeys(map(tuple, c.tolist()))])        # distinct, in order
    many = {run: c for run, c in centres.items() if len(c) > run[0]}
    if many:
        counts = sweep(many)
        centres.update((run, local_centres(c, counts[run][:, -2], run[0])) for run, c in many.items())
    return centres
