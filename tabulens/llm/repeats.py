"""Removal of byte strings that repeat across or within documents.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else, in another document or the same one.

*Parse*: every window of ``length`` bytes has an anchor, the smallest hash of the 8-byte grams among its first
``SPAN`` places.  Equal windows have equal anchors at equal offsets, and an anchor's windows are consecutive, so that
the anchors (about 1 in 33 bytes) stand for all windows.  All windows of an anchor share the bytes from it up to
``length - SPAN + 1`` further on, its core: an anchor whose core occurs once has no repeated window.

*Suffix order*: the phrases from anchor to anchor are the symbols of a string per stretch of anchors with repeated
cores; equal stretches are taken once.  Their suffixes are ordered by the difference-cover algorithm (``suffix_ranks``): triples at places 1 and 2 modulo
3 are sorted and named, the string of names is ordered recursively until names tell all apart or span a window, and
the remaining suffixes are merged in by their first symbols and the rank that follows.  Neighbours in that order with
equal phrases over the part of the core that anchors alike in both (``SECURE`` bytes) form a group.

*Windows*: within a group, anchors with equal bytes around them are one context with a count; the windows of the
distinct contexts are compared place by place.  Groups of very many contexts are compared by an exchange of their
windows instead of in one task; both ways are exact.  Texts that occur more than once as a whole are removed as a
whole (if long enough) and take part once.

Every step is written; its table and its shuffle files go as soon as the last step that reads them has ended.

Defined cases: null and empty texts keep nothing and lose nothing; texts shorter than ``length`` are kept; ids may be
null or repeat; extra columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import batches, col, drop_tables, packed_table, parts_for

GRAM, SPAN = 8, 64
HASH = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = 28                  # places in a batch of texts


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * HASH
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def span_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from every place, by doubling."""
    power, done, out, h = 1, 0, None, mixed(data.astype(np.uint64) + np.uint64(1))
    while True:
        if length & power:
            part = shifted(h, done)
            out = part if out is None else mixed(out * np.uint64(31) + part)
            done += power
        if done == length:
            return out
        h = mixed(h * np.uint64(17) + shifted(h, power) + np.uint64(power))
        power *= 2


def anchors(texts: list[bytes], length: int):
    """Per text its anchors' places and, for those with windows, first and last window and the hash of the core.

    Texts have ``length`` bytes or more.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    core = span_hashes(data, length - SPAN + 1)
    grams = span_hashes(data, GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~place) | np.arange(len(data), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32):            # smallest of SPAN grams, leftmost of equal ones
        ahead = shifted(least, step)
        ahead[len(data) - step:] = ~np.uint64(0)
        least = np.minimum(least, ahead)
    at = (least & place).astype(np.int64)
    start, out = 0, []
    for text in texts:
        own = at[start:start + len(text) - SPAN - GRAM + 2] - start
        first = np.flatnonzero(np.diff(own, prepend=-1))
        windows = len(text) - length + 1
        held = int(np.searchsorted(first, windows))          # later anchors have no whole window, but end phrases
        last = np.minimum(np.append(first[1:], len(own))[:held] - 1, windows - 1)
        out.append((own[first], first[:held], last, core[start + own[first[:held]]].view(np.int64)))
        start += len(text)
    return out


def parse(corpus: DataFrame, length: int) -> DataFrame:
    """(rid, key, place, first, last, core): one row per text with arrays over its anchors; rid numbers the texts."""

    def run(frames):
        from pyspark import TaskContext
        part, seen = TaskContext.get().partitionId(), 0
        for frame in frames:
            for own in batches(frame):
                found = anchors([bytes(t) for t in own["text"]], length)
                rows = pd.DataFrame({"rid": (part << 33) + seen + np.arange(len(own)), "key": own["key"].to_numpy()})
                for i, name in enumerate(("place", "first", "last", "core")):
                    rows[name] = [f[i] for f in found]
                seen += len(own)
                yield rows

    return corpus.mapInPandas(run, "rid long, key binary, place array<int>, first array<int>, last array<int>, core array<long>")


def secure(length: int) -> int:
    """Bytes from an anchor over which equal windows have equal anchors whatever follows them."""
    return length - GRAM - 2 * SPAN + 2


def contexts(chosen: DataFrame, length: int, remembered: int = 1 << 17) -> DataFrame:
    """One row per anchor with a repeated core: its context (the bytes of all its windows) and its place in a stretch.

    A stretch is a run of anchors that have repeated cores or lie in the secure part after one; its symbols are the
    phrases from anchor to anchor.  Contexts and stretches go by digests; a task spells each out the first time it
    meets it (of the last ``remembered`` ones) and leaves it null after that.
    """
    reach = secure(length)

    def digest(data: bytes) -> bytes:
        return hashlib.blake2b(data, digest_size=16).digest()

    def run(frames):
        spelled: set = set()
        for frame in (part for whole in frames for part in batches(whole)):
            out = []
            for row in frame.itertuples(index=False):
                text, place = bytes(row.text), row.place
                ends = np.append(place[1:], len(text))
                edge = np.zeros(len(place) + 1, dtype=np.int64)
                edge[row.repeated] += 1
                np.add.at(edge, np.searchsorted(place, place[row.repeated] + reach), -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                repeated = set(row.repeated.tolist())
                for stretch in np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1):
                    names = [hashlib.blake2b(text[place[i]:ends[i]], digest_size=8).digest() for i in stretch]
                    sid = digest(b"".join(names))
                    syms = sizes = None
                    if sid not in spelled:
                        spelled.add(sid)
                        syms = [(int.from_bytes(n, "little") >> 1) | 1 for n in names]
                        sizes = (ends[stretch] - place[stretch]).tolist()
                    for j, i in enumerate(stretch.tolist()):
                        if i not in repeated:
                            continue
                        lo, hi, m = int(row.first[i]), int(row.last[i]), int(place[i])
                        around = text[lo:hi + length]
                        h = digest(b"%d,%d," % (m - lo, m - hi) + around)
                        known = h in spelled
                        spelled.add(h)
                        out.append((row.rid, m, h, m - lo, m - hi, None if known else around, sid, j, syms, sizes))
                        syms = sizes = None
                if len(spelled) > remembered:
                    spelled = set()
            yield pd.DataFrame(out, columns=["rid", "m", "h", "far", "near", "bytes", "sid", "j", "syms", "sizes"])

    return chosen.mapInPandas(run, "rid long, m int, h binary, far int, near int, bytes binary, sid binary, j int, "
                                   "syms array<long>, sizes array<int>")


def stretch_symbols(stretches: DataFrame, reach: int, rows_a_frame: int = 1 << 14) -> DataFrame:
    """(seg, pos, sym, size, sid, head): the distinct stretches symbol by symbol, ``head`` the symbols of the secure part
    (null where less than that is left).  A task holds about ``rows_a_frame`` symbols at once, however long its stretches.
    """
    columns = ["seg", "pos", "sym", "size", "sid", "head"]

    def run(frames):
        for frame in frames:
            out = []
            for seg, sid, syms, sizes in zip(frame["seg"], frame["sid"], frame["syms"], frame["sizes"]):
                upto = np.concatenate([[0], np.cumsum(sizes)])
                need = np.searchsorted(upto, upto[:-1] + reach)
                raw = np.asarray(syms, dtype="<i8")
                for start in range(0, len(need), rows_a_frame):
                    out += [(seg, pos, int(syms[pos]), int(sizes[pos]), sid, raw[pos:n].tobytes() if n < len(upto) else None)
                            for pos, n in enumerate(need[start:start + rows_a_frame], start)]
                    if len(out) >= rows_a_frame:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return stretches.mapInPandas(run, "seg long, pos int, sym long, size int, sid binary, head binary")


def in_order(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys``; ``ties`` spread equal keys over partitions."""
    return df.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)


def boundaries(rows: DataFrame, keys: list[str], sums: list) -> list:
    """One row per partition in order, with its first and last key; partitions, not rows, reach the driver."""
    key = F.struct(*keys)
    return sorted(rows.groupBy("pid").agg(F.min(key).alias("low"), F.max(key).alias("high"), *sums).collect(),
                  key=lambda r: r["pid"])


def smaller_counts(df: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """``df`` (written) with ``less_<class>``: rows of the class (0/1 columns) whose keys are strictly smaller.

    One range exchange that splits ties; the counts of earlier partitions are added from a table of partitions.
    """
    less = [f"less_{c}" for c in classes]

    def run(frames):
        from pyspark import TaskContext
        pid, seen, opened, old, leading = TaskContext.get().partitionId(), np.zeros(len(classes), dtype=np.int64), None, None, True
        for frame in frames:
            if not len(frame):
                continue
            values = frame[keys].to_numpy(dtype=np.int64)
            new = np.append(old is not None and (values[0] != old).any(), (values[1:] != values[:-1]).any(1))
            flags = frame[classes].to_numpy(dtype=np.int64)
            before = np.cumsum(flags, axis=0) - flags + seen
            opened = before[0].copy() if opened is None else opened
            group = np.cumsum(new)
            starts = np.vstack([opened, before[new]])
            frame[less] = starts[group]
            frame["leading"] = leading & (group == 0)
            frame["pid"] = pid
            leading &= not new.any()
            seen, opened, old = seen + flags.sum(0), starts[-1], values[-1]
            yield frame

    kept = df.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", " + ", ".join(
        f"{c} long" for c in less) + ", leading boolean, pid int"
    ordered = in_order(df, keys, ["seg", "pos"]).mapInPandas(run, schema)
    rows = packed_table(ordered)
    offsets, total, tail, high = [], [0] * len(less), [0] * len(less), None
    for r in boundaries(rows, keys, [F.sum(c).alias(f"n_{c}") for c in classes] + [F.max(c).alias(c) for c in less]):
        shared = tail if r["low"] == high else [0] * len(less)          # rows equal to its first key, further left
        offsets.append((r["pid"], *total, *[t - s for t, s in zip(total, shared)]))
        counts = [r[f"n_{c}"] for c in classes]
        tail = [n - r[c] + (s if r["low"] == r["high"] else 0) for n, c, s in zip(counts, less, shared)]
        total, high = [t + n for t, n in zip(total, counts)], r["high"]
    names = [f"{kind}{c}" for kind in ("total_", "lead_") for c in less]
    table = df.sparkSession.createDataFrame(offsets, "pid int, " + ", ".join(f"{c} long" for c in names))
    placed = rows.join(F.broadcast(table), "pid")                       # a row per partition
    return placed.select(*kept, *[F.when(F.col("leading"), F.col(f"lead_{c}")).otherwise(F.col(f"total_{c}") + F.col(c)).alias(c)
                                  for c in less])


def next_ones(value: str, by: int):
    """``value`` of the symbol ``by`` places on in the same stretch, 0 past its end."""
    w = Window.partitionBy("seg").orderBy("pos")
    return F.when(F.lead("pos", by).over(w) == F.col("pos") + by, F.coalesce(F.lead(value, by).over(w), F.lit(0))).otherwise(0)


def suffix_ranks(strings: DataFrame, reach: int) -> DataFrame:
    """(seg, pos, rank): how many suffixes of the strings (seg, pos, sym > 0, size) are smaller, by difference cover 3.

    Stretches of consecutive ``pos`` are strings; suffixes may tie where they agree over ``reach`` of size or to their
    ends.
    """
    whole = strings.select("seg", "pos", F.col("sym").alias("s0"), next_ones("sym", 1).cast("long").alias("s1"),
                           next_ones("sym", 2).cast("long").alias("s2"),
                           (F.col("size") + next_ones("size", 1) + next_ones("size", 2)).cast("long").alias("size"))
    whole = packed_table(whole.withColumn("one", F.lit(1)))
    triples = whole.where("pos % 3 <> 0")
    named = smaller_counts(triples, ["s0", "s1", "s2"], ["one"]).withColumn("name", F.col("less_one") + 1)
    row = named.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"),
                    F.min(F.when(F.col("s2") > 0, F.col("size"))).alias("least")).first()
    if row["n"] == row["names"] or row["least"] is None or row["least"] >= reach:
        ranks = named.select("seg", "pos", F.col("name").alias("r"))
    else:
        inner = named.select((F.col("seg") * 2 + F.col("pos") % 3 - 1).alias("seg"), F.expr("CAST(pos div 3 AS INT)").alias("pos"),
                             F.col("name").alias("sym"), "size")
        ranks = suffix_ranks(inner, reach).select(
            F.expr("seg div 2").alias("seg"), (F.col("pos") * 3 + F.col("seg") % 2 + 1).cast("int").alias("pos"),
            (F.col("rank") + 1).alias("r"))
    joined = whole.join(ranks, ["seg", "pos"], "left")
    known = packed_table(joined.select("seg", "pos", "s0", "s1", "r", next_ones("r", 1).cast("long").alias("r1"),
                                       next_ones("r", 2).cast("long").alias("r2"),
                                       *[(F.col("pos") % 3 == c).cast("int").alias(f"c{c}") for c in range(3)]))
    drop_tables(whole, named, ranks)
    first = smaller_counts(known.where("c2 = 0").select("seg", "pos", "s0", "r1", "r", "c0", "c1"), ["s0", "r1"], ["c0", "c1"])
    second = smaller_counts(known.where("c1 = 0").select("seg", "pos", "s0", "s1", "r2", "r", "c0", "c2"),
                            ["s0", "s1", "r2"], ["c0", "c2"])
    drop_tables(known)
    zero = first.where("c0 = 1").select("seg", "pos", (F.col("less_c0") + F.col("less_c1")).alias("a")).join(
        second.where("c0 = 1").select("seg", "pos", "less_c2"), ["seg", "pos"]).select(
        "seg", "pos", (F.col("a") + F.col("less_c2")).alias("rank"))
    others = [side.where(f"{own} = 1").select("seg", "pos", (F.col("r") - 1 + F.col("less_c0")).alias("rank"))
              for side, own in ((first, "c1"), (second, "c2"))]
    return zero.union(others[0]).union(others[1])


def adjacent_groups(ordered: DataFrame) -> DataFrame:
    """``ordered`` (rank, head, ...) with ``grp``: runs of neighbours in rank order with equal heads have one number."""

    def run(frames):
        from pyspark import TaskContext
        pid, done, old = TaskContext.get().partitionId(), 0, None
        for frame in frames:
            if not len(frame):
                continue
            heads = frame["head"].map(bytes)
            new = heads.ne(heads.shift(fill_value=heads.iloc[0] if old is None else old)).to_numpy()
            frame["grp"] = done + np.cumsum(new)
            frame["pid"] = pid
            done, old = int(frame["grp"].iloc[-1]), heads.iloc[-1]
            yield frame

    kept = ordered.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", grp long, pid int"
    rows = packed_table(in_order(ordered, ["rank"], ["seg", "pos"]).mapInPandas(run, schema))
    offsets, base, high = [], 0, None
    for r in boundaries(rows, ["rank", "head"], [F.max("grp").alias("most")]):
        base += high is not None and bytes(r["low"]["head"]) != high
        offsets.append((r["pid"], base))
        base, high = base + r["most"], bytes(r["high"]["head"])
    table = ordered.sparkSession.createDataFrame(offsets, "pid int, base long")
    return rows.join(F.broadcast(table), "pid").select(*kept, (F.col("grp") + F.col("base")).alias("grp"))


def repeated_windows(frame: pd.DataFrame, length: int) -> list[list[int]]:
    """Per context (grp, n, far, near, bytes) the offsets before its anchor at which a repeated window starts."""
    raw = [bytes(b) for b in frame["bytes"]]
    width = max(map(len, raw))
    data = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), dtype=np.uint8).reshape(-1, width)
    far, near, n = (frame[c].to_numpy(dtype=np.int64) for c in ("far", "near", "n"))
    grp = mixed(frame["grp"].to_numpy(dtype=np.int64).view(np.uint64))
    sums = []
    for seed in (1, 2):                          # two 64-bit rolling sums over random values of the bytes
        rng = np.random.default_rng(seed)
        values, base = rng.integers(1, 2 ** 63, 256, dtype=np.uint64), rng.integers(1, 2 ** 62, dtype=np.uint64) | np.uint64(1)
        prefix = np.zeros((width + 1, len(raw)), dtype=np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * base + values[data[:, i]]
        sums.append((prefix, np.uint64(pow(int(base), length, 2 ** 64))))
    found: list[list[int]] = [[] for _ in raw]
    for k in range(int(near.min()), int(far.max()) + 1):
        rows = np.flatnonzero((near <= k) & (k <= far))
        at = far[rows] - k
        one, two = (prefix[at + length, rows] - prefix[at, rows] * power for prefix, power in sums)
        one = one ^ grp[rows]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(rows) else np.zeros(0, dtype=bool)
        run = np.cumsum(new) - 1
        often = np.bincount(run, weights=n[rows][order])[run] >= 2 if len(rows) else new
        for i in rows[order][often]:
            found[i].append(k)
    return found


def repeated_offsets(distinct: DataFrame, length: int, contexts_a_task: int, most_contexts: int) -> DataFrame:
    """(h, ks): for each distinct context (grp, h, n, far, near, bytes) with repeated windows their offsets before the
    anchor."""
    counts = distinct.groupBy("grp").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("rows")).where("rows > 1")
    sized = packed_table(distinct.join(counts, "grp").drop("rows"))
    buckets = parts_for(sized.count(), contexts_a_task)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        found = repeated_windows(frame, length)
        out = frame[["h"]].copy()
        out["ks"] = found
        return out[out["ks"].map(len) > 0]

    small = sized.where(F.col("contexts") <= most_contexts).groupBy(F.pmod(F.hash("grp"), F.lit(buckets))).applyInPandas(
        run, "h binary, ks array<int>")
    windows = sized.where(F.col("contexts") > most_contexts).select(
        "grp", "h", "n", F.explode(F.sequence("near", "far")).alias("k"), "far", "bytes").select(
        "grp", "h", "n", "k", F.unhex(F.md5(F.expr(f"substring(bytes, far - k + 1, {length})"))).alias("w"))
    often = windows.groupBy("grp", "k", "w").agg(F.sum("n").alias("n")).where("n > 1").select("grp", "k", "w")
    large = windows.join(often, ["grp", "k", "w"]).groupBy("h").agg(F.collect_list("k").alias("ks"))
    found = packed_table(small.union(large))
    drop_tables(sized)
    return found


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False, contexts_a_task: int = 20_000, most_contexts: int = 20_000) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the bytes left) on demand."""
    if secure(length) < 1:
        raise ValueError(f"length must be at least {GRAM + 2 * SPAN - 1}")
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    long_rows = rows.where(F.octet_length("text") >= length)
    copies = packed_table(long_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    corpus = long_rows.join(copies, "key", "left_anti").select("key", "text").union(
        long_rows.join(copies, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")))

    parsed = packed_table(parse(corpus, length))
    hot = packed_table(parsed.select(F.explode("core").alias("core")).groupBy("core").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("core"))
    repeated = parsed.select("rid", F.posexplode("core").alias("i", "core")).join(hot, "core", "left_semi").groupBy(
        "rid").agg(F.sort_array(F.collect_list("i")).alias("repeated"))
    chosen = packed_table(parsed.drop("core").join(repeated, "rid"))
    drop_tables(parsed, hot)
    anchored = packed_table(contexts(corpus.join(chosen, "key"), length))

    stretches = packed_table(anchored.where(F.col("syms").isNotNull()).groupBy("sid").agg(
        F.first("syms").alias("syms"), F.first("sizes").alias("sizes")).withColumn("seg", F.monotonically_increasing_id()))
    symbols = packed_table(stretch_symbols(stretches, secure(length)))
    drop_tables(stretches)
    ranks = suffix_ranks(symbols.select("seg", "pos", "sym", "size"), secure(length))
    groups = adjacent_groups(symbols.where(F.col("head").isNotNull()).join(ranks, ["seg", "pos"]).select(
        "rank", "seg", "pos", "sid", "head")).select("sid", F.col("pos").alias("j"), "grp")
    drop_tables(symbols, ranks)
    distinct = anchored.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.first("far").alias("far"), F.first("near").alias("near"),
        F.first("bytes", ignorenulls=True).alias("bytes"), F.min(F.struct("sid", "j")).alias("at"))
    distinct = packed_table(distinct.select("h", "n", "far", "near", "bytes", "at.sid", "at.j").join(
        groups, ["sid", "j"]).select("grp", "h", "n", "far", "near", "bytes"))
    drop_tables(groups)
    found = repeated_offsets(distinct, length, contexts_a_task, most_contexts)
    hits = packed_table(anchored.select("h", "rid", "m").join(found, "h").groupBy("rid").agg(
        F.collect_list(F.struct("m", "ks")).alias("hits")).join(chosen.select("rid", "key"), "rid").select("key", "hits"))
    drop_tables(chosen, anchored, distinct, found)

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(text: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(text, hits):
            if t is None:
                out.append((0, 0, b""))
                continue
            t = bytes(t)
            edge = np.zeros(len(t) + 1, dtype=np.int64)
            starts = np.unique(np.concatenate([h["m"] - np.asarray(h["ks"]) for h in own]))
            edge[starts] += 1
            np.add.at(edge, starts + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            out.append((int(gone.sum()), runs, np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    joined = rows.join(copies.select("key", F.lit(True).alias("copied")), "key", "left").join(hits, "key", "left")
    n_bytes = F.octet_length("text").cast("long")
    whole = F.coalesce(F.col("copied"), F.lit(False)) & (n_bytes >= length)
    part = F.col("hits").isNotNull() & ~whole
    done = joined.withColumn("cut", cut(F.when(part, F.col("text")), F.when(part, F.col("hits"))))
    kept = F.when(whole, F.lit(b"")).when(part, F.col("cut.kept")).otherwise(F.col("text"))
    return done.select(
        F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"),
        F.when(whole, n_bytes).otherwise(F.col("cut.n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("cut.n_spans")).cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept")] if with_text else []))
