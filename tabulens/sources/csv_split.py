"""Quoted CSV read by many tasks: the quote state of every byte split, then the records that begin in it.

A line break inside quotes does not end a record, so a task that starts in the middle of a file has to know whether it
starts inside a quoted field.  Every line is a map on the two states (outside, inside quotes); two patterns say where
it leads from either.  A first pass composes the maps of each split, a prefix over the splits of a file gives the state
each one starts in, and a second pass puts lines together to records.  Only the pieces of records that cross a split's
border, at most two a split, are exchanged.  Both passes take lines by the batch; the pieces are written once, so that
later reads of the table do not put them together again.

A quote opens a field only at the start of it and closes it only before a comma or the line's end; any other stays a
character.  Lines end in \\n or \\r\\n.  Blank lines outside quotes are no records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Possessive throughout: one pass over a line, no backtracking.
_BODY = r'[^"]*+(?:""[^"]*+)*+'                         # inside quotes, doubled quotes included
_FIELDS = rf'(?:(?:"{_BODY}"[^,]*+|(?!")[^,]*+),)*+'    # whole fields, each with its comma
_OPEN = rf'{_FIELDS}"{_BODY}\z'                         # whole fields, then one that stays open
OPENS = rf'\A\x{{FEFF}}?+{_OPEN}'
STAYS = rf'\A{_BODY}(?:\z|"[^,]*+,{_OPEN})'

#: The start states of up to this many splits are broadcast (a path, an offset and a flag each); beyond, they are joined.
BROADCAST_SPLITS = 50_000

_SUMMARY = "file string, block long, from_out boolean, from_in boolean"
_PIECES = "file string, block long, seq long, kind string, first boolean, text string"


def _lines(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """Lines in file order, with their split and whether they end inside quotes from either state."""
    text = F.col("value") if encoding is None else F.decode(F.col("value").cast("binary"), encoding)
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    text.alias("text"))
            .withColumn("opens", F.col("text").rlike(OPENS)).withColumn("stays", F.col("text").rlike(STAYS)))


def _runs(batch):
    """(file, block, first row, end) of the runs of a batch's rows that lie in one split."""
    files = pc.dictionary_encode(batch.column(0))
    names, blocks = files.indices.to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
        if hi > lo:
            yield files.dictionary[int(names[lo])].as_py(), int(blocks[lo]), lo, hi


def _flags(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _states(opens: np.ndarray, stays: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line ends inside quotes: the last line that leads to one state from both, then the swaps since."""
    fixes, swaps = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(fixes, np.arange(len(opens)), -1))
    known = last >= 0
    return np.where(known, opens[last], start) ^ ((swaps - np.where(known, swaps[last], 0)) % 2 == 1)


def _summarise_fn():
    def summarise(batches):
        """Compose the maps of each split's lines; a task reads its splits one after the other, in file order."""
        key, out, inn = None, False, True
        for batch in batches:
            opens, stays = _flags(batch.column(2)), _flags(batch.column(3))
            for file, block, lo, hi in _runs(batch):
                if key != (file, block):
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "from_out": [out],
                                                          "from_in": [inn]})
                    key, out, inn = (file, block), False, True
                out, inn = (bool(_states(opens[lo:hi], stays[lo:hi], s)[-1]) for s in (out, inn))
        if key is not None:
            yield pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "from_out": [out], "from_in": [inn]})
    return summarise


def start_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside): the state every split starts in.

    A split whose lines lead to one state from both fixes it; after that, only swaps of the two count.
    """
    maps = lines.select("file", "block", "opens", "stays").mapInArrow(_summarise_fn(), _SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)   # a row a split
    fixed = F.col("from_out") == F.col("from_in")
    upto = Window.partitionBy("file").orderBy("block")
    return (maps.withColumn("swaps", F.sum(F.when(~fixed & F.col("from_out"), 1).otherwise(0)).over(upto))
            .withColumn("fix", F.when(fixed, F.struct(F.col("from_out").alias("state"), F.col("swaps").alias("at"))))
            .withColumn("last", F.last("fix", ignorenulls=True).over(before))
            .withColumn("n", F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(F.col("last.at"), F.lit(0)))
            .select("file", "block",
                    (F.coalesce(F.col("last.state"), F.lit(False)) != (F.col("n") % 2 == 1)).alias("inside")))


def _assemble_fn():
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()),
                        ("first", pa.bool_()), ("text", pa.string())])

    def assemble(batches):
        """Records of each split.  ``whole`` ones are ready; ``head`` closes a record of an earlier split, ``tail`` begins
        one that a later split closes, ``mid`` is a split inside one record.  ``first`` marks the file's header."""
        key, state, seq, buffer, kind, header = None, False, 0, [], "whole", False

        def pieces(texts, kinds):
            """A batch of the split's records, blank ones left out (``texts``: Arrow strings)."""
            nonlocal seq, header
            kept = np.ones(len(texts), dtype=bool)
            plain = _flags(pc.match_substring_regex(texts, "[!-~]"))
            for i in np.flatnonzero(~plain):
                kept[i] = kinds[i] != "whole" or bool(texts[int(i)].as_py().strip())
            if not kept.all():
                texts, kinds = texts.filter(pa.array(kept)), [k for k, keep in zip(kinds, kept) if keep]
            first = np.zeros(len(texts), dtype=bool)
            if header:
                begins = [i for i, k in enumerate(kinds[:2]) if k in ("whole", "tail")]      # only the first is a head
                if begins:
                    first[begins[0]], header = True, False
            n, seq = len(texts), seq + len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1], dtype=np.int64)),
                 pa.array(np.arange(seq - n, seq)), pa.array(kinds, pa.string()), pa.array(first),
                 texts.cast(pa.string())], schema=schema)

        def finish():
            if buffer:
                text = pa.array(["\n".join(t for part in buffer for t in part.to_pylist())], pa.string())
                yield pieces(text, ["mid" if kind == "head" else "tail"])

        for batch in batches:
            opens, stays, inside = (_flags(batch.column(i)) for i in (3, 4, 5))
            for file, block, lo, hi in _runs(batch):
                if key != (file, block):
                    yield from finish()
                    key, state, seq, buffer = (file, block), bool(inside[lo]), 0, []
                    kind, header = "head" if state else "whole", block == 0
                after = _states(opens[lo:hi], stays[lo:hi], state)
                state = bool(after[-1])
                ends = np.flatnonzero(~after) + 1                       # behind the last line of every closed record
                if not len(ends):
                    buffer.append(batch.column(2).slice(lo, hi - lo))
                    continue
                early = sum(len(part) for part in buffer)
                lines = pa.concat_arrays([*buffer, batch.column(2).slice(lo, int(ends[-1]))])
                at = pa.array(np.concatenate([[0], ends + early]).astype(np.int32))
                yield pieces(pc.binary_join(pa.ListArray.from_arrays(at, lines), "\n"),
                             [kind] + ["whole"] * (len(ends) - 1))
                rest = batch.column(2).slice(lo + int(ends[-1]), hi - lo - int(ends[-1]))
                buffer, kind = [rest] if len(rest) else [], "whole"
        yield from finish()
    return assemble


def records(spark: SparkSession, path: str, encoding: str | None = None,
            broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(first, text): every record of the files as text, the header of each file marked ``first``.

    ``encoding`` (None: UTF-8) has to keep ASCII bytes as they are.  Both passes have to see the same splits; should the
    session's settings or cores change between them, the query raises instead of giving wrong records.  A quoted
    field that the file never closes ends with the file.
    """
    from tabulens.session import written_table
    lines = _lines(spark, path, encoding)
    starts = written_table(start_states(lines))
    n = starts.count()
    if n <= broadcast_splits:           # the lines stay where they are, in their order
        tagged = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:                               # a split is one group of at most spark.sql.files.maxPartitionBytes
        placed = lines.withColumn("at", F.monotonically_increasing_id())
        tagged = (placed.repartition("file", "block").join(starts.repartition("file", "block"), ["file", "block"], "left")
                  .sortWithinPartitions("file", "block", "at"))
    checked = F.when(F.col("inside").isNotNull(), F.col("inside")).otherwise(
        F.raise_error(F.lit("byte splits changed between the passes over the CSV; fix spark.sql.files.minPartitionNum"))
        .cast("boolean"))
    pieces = written_table(tagged.select("file", "block", "text", "opens", "stays", checked.alias("inside"))
                           .mapInArrow(_assemble_fn(), _PIECES))
    crossing = pieces.where(F.col("kind") != "whole")                       # at most two a split
    order = Window.partitionBy("file").orderBy("block", "seq")
    joined = (crossing.withColumn("rec", F.count(F.when(F.col("kind") == "tail", 1)).over(order))
              .groupBy("file", "rec").agg(F.max("first").alias("first"),
                                          F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
              .select("first", F.array_join(F.col("parts.text"), "\n").alias("text")))
    out = pieces.where(F.col("kind") == "whole").select("first", "text").unionByName(joined)
    return out.withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def read_quoted(spark: SparkSession, path: str, names: list[str], encoding: str | None = None) -> DataFrame:
    """The files' records as string columns ``names``; missing fields are null, surplus ones are dropped."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("text", schema, {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    parsed = records(spark, path, encoding).where(~F.col("first")).select(row.alias("r"))
    return parsed.select(*[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(names)])
