"""Histogram sort: shards of near-equal bytes from iteratively refined splitters.

Rows are ordered by a 64-bit key (a hash of id and text, so that copies of one
text spread evenly).  The key space is probed at evenly spaced boundaries; the
exact bytes below every probe are counted across all partitions, and only the
intervals that still hold an unmet splitter are probed again, 256 times finer.
When every splitter is within tolerance, one exchange puts the rows in place.

What reaches the driver is the histogram of the open intervals: at most
(shards - 1) * 256 rows a pass after the first, whatever the table's size.

Defined cases: a null text has 0 bytes, so size 1, and the CRC of an empty
string; null ids are ordinary key input; rows equal in id and text share a key
and stay in one shard; an empty table gives an empty result; other columns are
carried along untouched by ``histogram_sort`` and may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, parts_for, spare_name, text_bytes
from tabulens.session import written_table

KEY_BITS = 64
FIRST_BITS, STEP_BITS = 10, 8


def shard_key(id_col: Column, text_col: Column) -> Column:
    """The sort key: a 64-bit hash of id and text."""
    return F.xxhash64(id_col, text_col)


def _prefix(key: Column, bits: int) -> Column:
    """The top ``bits`` of the key in sort order (as an unsigned number of ``bits`` bits)."""
    unsigned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return unsigned if bits == KEY_BITS else F.shiftrightunsigned(unsigned, KEY_BITS - bits)


def find_splitters(keyed: DataFrame, key: str, weight: str, n_shards: int, tolerance: float) -> list[int]:
    """Splitters in unsigned key order: shard i takes the keys from splitter i-1 up to splitter i.

    ``tolerance`` is the accepted miss of each splitter as a share of one shard's weight.  A splitter inside a
    single key (rows that cannot be told apart) is set at the nearer edge of that key.
    """
    bits = FIRST_BITS
    hist = (keyed.groupBy(_prefix(col(key), bits).alias("p")).agg(F.sum(col(weight)).alias("w")).collect())
    total = sum(r["w"] for r in hist)
    if not total:
        return [0] * (n_shards - 1)
    targets = {i: total * (i + 1) / n_shards for i in range(n_shards - 1)}
    slack = max(1.0, tolerance * total / n_shards)
    below = {0: 0}                       # open interval (prefix at the coarser level) -> weight below it
    groups = {0: sorted((r["p"], r["w"]) for r in hist)}
    found: dict[int, int] = {}
    width = FIRST_BITS
    wanted = {0: list(targets)}          # open interval -> splitters that fall in it
    while True:
        again: dict[int, list[int]] = {}
        base: dict[int, int] = {}
        for start, split_ids in wanted.items():
            rows = groups.get(start, [])
            edges, ends, acc = [], [], below[start]
            for p, w in rows:
                edges.append((p, acc))
                acc += w
                ends.append(acc)
            for i in split_ids:
                j = min(bisect_left(ends, targets[i]), len(rows) - 1)
                p, left = edges[j]
                if targets[i] - left <= slack or ends[j] - targets[i] <= slack or bits == KEY_BITS:
                    nearer_left = targets[i] - left <= ends[j] - targets[i]
                    found[i] = (p if nearer_left else p + 1) << (KEY_BITS - bits)
                else:
                    again.setdefault(p, []).append(i)
                    base[p] = left
        if not again:
            return [found[i] for i in range(n_shards - 1)]
        width = min(STEP_BITS, KEY_BITS - bits)
        outer, bits = bits, bits + width
        unsigned = _prefix(col(key), bits)
        # probed only inside the open intervals; at most (shards - 1) * 2**width rows come back
        rows = (keyed.where(_prefix(col(key), outer).isin(list(again)))
                .groupBy(unsigned.alias("p")).agg(F.sum(col(weight)).alias("w")).collect())
        groups = {s: [] for s in again}
        for p, w in sorted(((r["p"] % (1 << bits), r["w"]) for r in rows)):
            groups[p >> width].append((p, w))
        below, wanted = base, again


def shard_of(key: Column, splitters: list[int]) -> Column:
    """Shard number: how many splitters lie at or below the key."""
    out = F.lit(0)
    for s in splitters:
        if s >= 1 << KEY_BITS:
            continue
        signed = s - (1 << 63)           # unsigned order as a signed long
        out = out + F.when(key >= F.lit(signed).cast("long"), 1).otherwise(0)
    return out.cast("int")


def histogram_sort(df: DataFrame, key: Column, weight: Column, n_shards: int = 8, tolerance: float = 0.001,
                   bucket_rows: int = 500_000, shard_name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """``df`` plus its shard and its slot in the shard (gapless from 0, in key order).

    The probing passes read a written table of (key, weight) only.  Slots come from exact row counts of fine key
    ranges of at most about ``bucket_rows`` rows each, so no task ever holds a whole shard.
    """
    k = spare_name(df, "key")
    keyed = df.withColumn(k, key)
    probe = written_table(keyed.select(col(k).alias("k"), weight.alias("w")))
    splitters = find_splitters(probe, "k", "w", n_shards, tolerance)
    n_rows = probe.count()
    bits = min(40, max(3, (parts_for(n_rows, bucket_rows) - 1).bit_length()))
    sized = (probe.groupBy(shard_of(F.col("k"), splitters).alias("s"), _prefix(F.col("k"), bits).alias("b"))
             .agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    s, b, o = (spare_name(keyed, x) for x in ("shard", "bucket", "offset"))
    placed = keyed.withColumn(s, shard_of(col(k), splitters)).withColumn(b, _prefix(col(k), bits))
    offsets = offsets.select(F.col("s").alias(s), F.col("b").alias(b), F.col("o").alias(o))
    joined = placed.join(offsets, [s, b])
    inside = Window.partitionBy(col(s), col(b)).orderBy(col(k))
    return (joined.withColumn(slot_name, (col(o) + F.row_number().over(inside) - 1).cast("long"))
            .withColumn(shard_name, col(s)).drop(k, s, b, o))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.001) -> DataFrame:
    """Documents in shards of near-equal bytes: id, text, size, text_crc32, shard, slot."""
    text = col(text_col)
    base = docs.select(col(id_col).alias("doc_id"), text.alias("text"), (text_bytes(text) + 1).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return histogram_sort(base, shard_key(F.col("doc_id"), F.col("text")), F.col("size"), n_shards, tolerance)
