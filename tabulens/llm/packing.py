"""Best-fit packing planned on the length histogram.

Documents become token pieces of at most ``capacity`` ids.  Best-fit decreasing
runs over the *counts* of the piece lengths, at most ``capacity`` of them, so
the plan does not grow with the corpus: it is a list of rank ranges ("the
pieces of length 700 with rank 40..89 go two by two into sequences 310..334 at
offset 0").  Pieces take their slots by joining on rank within length.

Ranks need no sort: while tokenising, each task numbers its pieces per length,
and exact (task, length) counts give every task its first rank.  The plan is
broadcast; it holds O(capacity) ranges by construction, whatever the corpus.

Defined cases: a null or empty text is one piece holding the end id alone; null
and repeated ids are packed row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, small_batches
from tabulens.session import written_table

END_ID = 0
#: Fixed values of the tokenizer file: its only special token.
SPECIAL = {"<|endoftext|>": 50256}


def encoder(vocabulary: str | None = None):
    """Byte-level BPE encoder with the ids of ``byte_bpe_50k.json``.

    ``vocabulary`` is the path of the same vocabulary in rank form (default: the installed public file).  The rank
    form encodes four times faster than the JSON form and gives the same ids; the tests hold the two together.
    """
    import public_tokenizers as P
    import tiktoken
    path = vocabulary or P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full pieces, but for a first one that takes the remainder."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None,
                    with_ids: bool) -> DataFrame:
    """One row per piece, with the task's number and the piece's rank among the task's pieces of its length."""
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(frames):
        import numpy as np
        enc = encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), {}
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = enc.encode(text, allowed_special="all") if text else []
                ids.append(END_ID)
                ids = np.array(ids, dtype="<u4")
                for piece, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    own = ids[start:start + length]
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), part, rank,
                                 *([own.astype("int32")] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = pd.Series([r[0] for r in rows], dtype=frame["doc_id"].dtype)
            yield out

    schema = (f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
              + ", ids array<int>" * with_ids)
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInPandas(run, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Returns ranges (length, from_rank, to_rank, first_sequence, per_sequence, offset): the pieces of that length with
    rank in [from_rank, to_rank) fill sequences first_sequence, ... with per_sequence each, from that offset on.
    """
    room: dict[int, list[tuple[int, int]]] = {}      # remaining room -> runs (first sequence, how many)
    sizes: list[int] = []                            # the sorted keys of room
    plan, opened = [], 0

    def put(rest: int, first: int, many: int):
        if rest and many:
            if rest not in room:
                insort(sizes, rest)
                room[rest] = []
            room[rest].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                many = -(-left // (capacity // length))
                put(capacity, opened, many)
                opened += many
                continue
            rest = sizes[i]
            first, many = room[rest].pop()
            if not room[rest]:
                del room[rest], sizes[i]
            each = rest // length                    # the tightest run stays the tightest until it is full
            full = min(many, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - rest))
                put(rest - each * length, first, full)
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if many and left:
                plan.append((length, rank, rank + left, first, left, capacity - rest))
                put(rest - left * length, first, 1)
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            put(rest, first, many)
    return plan


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``with_ids`` adds the piece's ids.  Sequences are numbered from 0.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = written_table(tokenize_pieces(docs, id_col, text_col, capacity, vocabulary, with_ids))
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    slots = spark.createDataFrame(
        plan, "length long, from_rank long, to_rank long, first_seq long, per_seq long, base long")
    rank = F.col("first_rank") + F.col("local_rank")
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", rank)
    nth = F.col("rank") - F.col("from_rank")
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "slot_length")),
                         (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank"))
                         & (F.col("rank") < F.col("to_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_seq") + F.expr("(rank - from_rank) div per_seq")).cast("long").alias("sequence_id"),
                         (F.col("base") + (nth % F.col("per_seq")) * F.col("length")).cast("long").alias("offset"),
                         *(["ids"] if with_ids else []))
