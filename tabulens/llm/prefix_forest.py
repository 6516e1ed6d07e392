"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree hashes a vector to a long bit string, one bit per random hyperplane,
and keeps the strings sorted.  A query descends to its longest matching prefix
in every tree and then ascends in all trees at once, one bit at a time, until
the matches of all trees together reach the wanted number; the candidates found
are scored exactly on the original vectors.  Vectors are first lifted by one
coordinate that makes all norms equal, so that the angle orders them as the
inner product does.

The rows are dealt into blocks of a bounded size by a hash of the id, each with
a forest of its own; a stated query set meets every block, and the best of all
blocks are merged.  Every row is indexed; nothing is fitted on a sample.

Defined cases: rows with a null id and vectors that are null, empty, zero or hold
null or non-finite components take no part; vectors meet those of their own
dimension only; rows with the query's id are its own; a repeated row is found as
often as it stands there; ties go to the smaller id; with fewer candidates than
wanted all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, parts_for

TREES, BITS = 128, 16
LEAST_MATCHES = 30          # matches wanted per result, besides the share of the block


def hyperplanes(dimension: int, seed: int) -> np.ndarray:
    """(dimension, TREES * BITS) normal vectors, the same for every block."""
    return np.random.default_rng(seed).standard_normal((dimension, TREES * BITS)).astype(np.float32)


def bit_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings of BITS bits, the first hyperplane's bit on top."""
    bits = (vectors.astype(np.float32) @ planes > 0).reshape(len(vectors), TREES, BITS)
    return bits.astype(np.int32) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int32))


class Forest:
    """Sorted hash strings of one block, tree by tree."""

    def __init__(self, vectors: np.ndarray, planes: np.ndarray):
        strings = bit_strings(vectors, planes)
        self.rows = len(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable").T.astype(np.int32)      # rows in string order
        # where in the sorted array each string would stand: the end points of every prefix are read off here
        self.starts = np.zeros((TREES, (1 << BITS) + 1), dtype=np.int32)
        for t in range(TREES):
            np.cumsum(np.bincount(strings[:, t], minlength=1 << BITS), out=self.starts[t, 1:])

    def candidates(self, strings: np.ndarray, wanted: int):
        """For every query its candidate rows: the deepest common prefix length with enough matches in all trees."""
        trees = np.arange(TREES)
        n = len(strings)
        lo = np.zeros((n, TREES), dtype=np.int32)
        hi = np.full((n, TREES), self.rows, dtype=np.int32)
        todo = np.arange(n)
        for length in range(BITS, 0, -1):
            shift = BITS - length
            prefix = strings[todo] >> shift
            a = self.starts[trees, prefix << shift]
            b = self.starts[trees, (prefix + 1) << shift]
            done = (b - a).sum(axis=1) >= wanted
            lo[todo[done]], hi[todo[done]] = a[done], b[done]
            todo = todo[~done]
            if not len(todo):
                break
        mark = np.zeros(self.rows, dtype=bool)
        for i in range(n):
            if hi[i, 0] - lo[i, 0] == self.rows:            # up to the root: everything
                yield np.arange(self.rows)
                continue
            for t in range(TREES):
                mark[self.order[t, lo[i, t]:hi[i, t]]] = True
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found


def lifted(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one more coordinate that makes their norms equal; queries of unit norm with a zero there."""
    norms = np.linalg.norm(rows, axis=1)
    top = norms.max()
    extra = np.sqrt(np.maximum(0.0, 1.0 - (norms / top) ** 2))
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    return np.column_stack([rows / top, extra]), np.column_stack([unit, np.zeros(len(unit))])


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in extended precision, rounded once: equal rows get equal scores."""
    return (rows.astype(np.longdouble) * query.astype(np.longdouble)).sum(axis=1).astype(np.float64)


def block_search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
                 share: float, seed: int):
    """(query number, row number, score) of each query's best ``k`` candidates in one block."""
    planes = hyperplanes(rows.shape[1] + 1, seed)
    high_rows, high_queries = lifted(rows, queries)
    forest = Forest(high_rows, planes)
    wanted = int(share * len(rows)) + LEAST_MATCHES * k
    found = forest.candidates(bit_strings(high_queries, planes), wanted)
    for i, candidates in enumerate(found):
        candidates = candidates[ids[candidates] != query_ids[i]]
        if not len(candidates):
            continue
        near = rows[candidates] @ queries[i]
        if len(near) > k:
            # keep all that could be among the best after exact scoring
            cut = np.partition(near, len(near) - k)[len(near) - k]
            keep = near >= cut - 1e-9 * max(1.0, abs(cut))
            candidates = candidates[keep]
        scores = exact_scores(rows[candidates], queries[i])
        best = np.lexsort((ids[candidates], -scores))[:k]
        yield i, candidates[best], scores[best]


def nearest_neighbours(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                       k: int = 20, share: float = 0.45, block_rows: int = 8192, chunk_rows: int = 16384,
                       seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for every query row.

    ``is_query`` is a condition on the id column.  ``share`` is how many matches, counted in all trees together, a
    query collects in a block as a share of the block's rows (``LEAST_MATCHES`` * ``k`` come on top, which decide in
    small blocks).  Queries are dealt into chunks of about
    ``chunk_rows``; every chunk meets every block in a task of its own.
    """
    vector = col(vector_col).cast("array<double>")
    usable = (vectors.select(col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
              .where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
              .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                     & F.exists("v", lambda x: x != 0)))
    total = usable.count()
    blocks, chunks = parts_for(total, block_rows), parts_for(total, 20 * chunk_rows)
    asked = usable.where(is_query).dropDuplicates(["vec_id", "v"])
    size = F.size("v").alias("dim")
    left = usable.select("vec_id", "v", size, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    right = asked.select("vec_id", "v", size, every_block.alias("block"),
                         F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"))

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy())
            query_ids, q = queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy())
            for i, best, scores in block_search(ids, x, query_ids, q, k, share, seed):
                out.append(pd.DataFrame({"query_id": query_ids[i], "query_key": zlib.crc32(q[i].tobytes()),
                                         "vec_id": ids[best], "score": scores}))
        empty = pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})
        return pd.concat(out) if out else empty

    keys = ["dim", "block", "chunk"]
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInPandas(search, "query_id long, query_key long, vec_id long, score double"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
