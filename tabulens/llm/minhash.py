"""Near-duplicates: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

A text's shingle set is hashed once; the smallest value of each of ``BINS`` bins
is its signature (one-permutation hashing), and an empty bin borrows from the
bin that a universal hash of (bin, attempt) names first (optimal densification).
Four bins make a band; texts with an equal band share a bucket.

Texts with equal sets collapse into one class before anything else.  In every
bucket only star-shaped edges are tried: all members against a few hubs.  The
first star of a class goes to the hub it shares most buckets with.  Classes
whose links are confirmed, on full shingle sets, become one component; a bucket
that still holds several components goes on with new hubs, taken from
outside its largest component, and a hub that has met everyone leaves it.  Buckets
close when one component is left, so no pair of a bucket is skipped.  A star only
has the edges that could be links: every class carries a bitmap of its shingles,
and the bits that one bitmap has and the other has not bound the intersection
from above.  That bound is exact, so it loses nothing, and it leaves few edges
besides the links.  A pair that shares several buckets is met in one of them.

At similarity 0.75 two texts miss every common bucket with probability
(1 - 0.75**4)**32, about 5e-6.

Defined cases: null and empty texts and texts of white space have an empty set
and are linked with nothing; texts with fewer words than a shingle are one
shingle; null ids form a component id of null when no linked id is known;
repeated rows are one class; an empty table gives no rows; other columns pass
through ``drop_near_duplicates`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import batches, col, small_batches, spare_name
from tabulens.llm.components import connected_components
from tabulens.session import written_table

BINS, BAND_ROWS = 128, 4
BANDS = BINS // BAND_ROWS
ATTEMPTS = (16, 2048)
BITMAP = 1024
FIRST_HUBS = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z in lower case, words at ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in words], dtype=np.uint64)
    n = len(words) - width + 1
    rolled = hashes[:n].copy()
    for i in range(1, width):
        rolled = rolled * MULTIPLIER + hashes[i:i + n]
    return np.unique(mixed(rolled))


def borrow_table(attempts: int) -> np.ndarray:
    """For every bin, the bins it borrows from, in order of attempt: a universal hash of (bin, attempt)."""
    grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(attempts, dtype=np.uint64)[None, :]
    return (mixed(grid + MULTIPLIER) % np.uint64(BINS)).astype(np.int64)


def signature(shingles: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Densified one-permutation signature of a sorted set that is not empty."""
    bins = (shingles >> np.uint64(64 - 7)).astype(np.int64)         # the top 7 bits name one of 128 bins
    first = np.flatnonzero(np.diff(bins, prepend=-1))               # the set is sorted: the first is the smallest
    out = np.zeros(BINS, dtype=np.uint64)
    filled = np.zeros(BINS, dtype=bool)
    out[bins[first]], filled[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~filled)
    for table in tables:
        if not len(empty):
            break
        hit = filled[table[empty]]
        at = hit.argmax(axis=1)
        ok = hit[np.arange(len(empty)), at]
        out[empty[ok]] = out[table[empty[ok], at[ok]]]
        empty = empty[~ok]
    if len(empty):                                                  # no attempt met a filled bin: the smallest value
        out[empty] = shingles[0]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for every band number."""
    rows = sig.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER
    for i in range(BAND_ROWS):
        key = mixed(key + rows[:, i] * MULTIPLIER)
    return key.view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The set hashed to ``BITMAP`` bits, as 64-bit numbers (by low bits: the bins go by high ones)."""
    bits = np.zeros(BITMAP, dtype=bool)
    bits[(shingles & np.uint64(BITMAP - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def set_id(shingles: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sign_documents(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, cid, bands, bits) of every document; the last three are null for an empty set."""
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(frames):
        tables = [borrow_table(n) for n in ATTEMPTS]
        for frame in (part for whole in frames for part in batches(whole)):
            sizes, ids, bands, bits = [], [], [], []
            for text in frame["text"]:
                s = shingle_set(text, width)
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                bands.append(band_keys(signature(s, tables)) if len(s) else None)
                bits.append(bitmap(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_shingles": sizes, "cid": ids, "bands": bands,
                                "bits": bits})

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return rows.mapInPandas(
        run, f"doc_id {id_type}, n_shingles long, cid binary, bands array<long>, bits array<long>")


def named_sets(frames, width: int):
    """(cid, shingles) of every text, in frames of about 1 MB of text: a set is as large as its text or larger."""
    for frame in (part for whole in frames for part in batches(whole)):
        sets = [shingle_set(t, width) for t in frame["text"]]
        yield pd.DataFrame({"cid": [set_id(s) if len(s) else None for s in sets],
                            "shingles": [s.view(np.int64) for s in sets]})


def class_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int,
               broadcast_rows: int) -> DataFrame:
    """(cid, shingles) of the wanted classes (cid, doc_id), one row each, from the texts of their first documents.

    Up to ``broadcast_rows`` wanted ids (some 50 bytes each) are sent to the scan, so that no text is shuffled;
    beyond that the join shuffles.
    """
    ids = wanted.select(F.col("doc_id").alias("first_id")).distinct()
    small = wanted.count() <= broadcast_rows
    rows = (docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
            .join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi"))

    # a repeated id can bring in other texts: only the wanted classes stay, once each
    found = (rows.select("text").mapInPandas(lambda frames: named_sets(frames, width), "cid binary, shingles array<long>")
             .where("cid is not null"))
    return found.join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return (both.select("a", "b", "sa", "sb", common.alias("common"))
            .where(100 * F.col("common") >= percent * union).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, cid, component_id) of every document; cid names the class of texts with an equal set."""
    with small_batches(docs.sparkSession):
        signed = written_table(sign_documents(docs, id_col, text_col, width))
    classes = written_table(
        signed.where("cid is not null").groupBy("cid")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
             F.first("bits").alias("bits")))
    member = classes.select("cid", "n", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key")
    bucket = written_table(member.join(shared, "key").select("key", "cid", "n"))
    wanted = written_table(classes.join(bucket.select("cid").distinct(), "cid", "left_semi"))
    with small_batches(docs.sparkSession):
        sets = written_table(class_sets(docs, wanted.select("cid", "doc_id"), id_col, text_col, width, broadcast_rows))

    # round 1: every class against the hub that it shares most buckets with
    hubs = bucket.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("hub"))
    near = (bucket.join(hubs, "key").where(F.col("cid") != F.col("hub.cid"))
            .where(similar_sizes(F.col("n"), F.col("hub.n"), percent))
            .groupBy(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).agg(F.count(F.lit(1)).alias("times")))
    best = near.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    component = connected_components(confirmed(best, sets, percent))

    hub_count, rest = FIRST_HUBS, bucket.select("key", "cid")
    while True:
        rows = open_rows(rest, component, wanted, hub_count)
        if not rows.limit(1).count():
            break
        component = joined_components(component, confirmed(star_pairs(rows, percent), sets, percent))
        rest = rows.where("not is_hub").select("key", "cid")
        hub_count *= 16

    first = (classes.join(component, F.col("cid") == F.col("node"), "left")
             .select("cid", "doc_id", F.coalesce("label", "cid").alias("label")))
    smallest = first.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = first.join(smallest, "label").select("cid", "component_id")
    return (signed.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
            .withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))))


def similar_sizes(n, m, percent: int):
    """Whether two sets of these sizes can be similar at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def open_rows(rest: DataFrame, component: DataFrame, traits: DataFrame, hub_count: int) -> DataFrame:
    """(key, cid, label, is_hub, n, bands, bits) of the buckets that hold more than one component.

    Hubs are about ``hub_count`` members outside each bucket's largest component, the first of its smallest component
    always among them.
    """
    labelled = written_table(rest.join(component, F.col("cid") == F.col("node"), "left")
                             .select("key", "cid", F.coalesce("label", "cid").alias("label")))
    parts = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("head"))
    chosen = (parts.groupBy("key")
              .agg(F.min(F.struct("size", "label", "head")).alias("lo"), F.max(F.struct("size", "label")).alias("hi"),
                   F.sum("size").alias("all"), F.count(F.lit(1)).alias("labels"))
              .where("labels > 1"))
    lot = F.pmod(F.xxhash64("key", "cid"), F.col("all") - F.col("hi.size")) < hub_count
    is_hub = (F.col("label") != F.col("hi.label")) & ((F.col("cid") == F.col("lo.head")) | lot)
    return written_table(labelled.join(chosen, "key").select("key", "cid", "label", is_hub.alias("is_hub"))
                         .join(traits.select("cid", "n", "bands", "bits"), "cid"))


def joined_components(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: the links are drawn between components, which are few, and solved there."""
    of = component.select(F.col("node").alias("a"), F.col("label").alias("la"))
    to = component.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = (links.join(of, "a", "left").join(to, "b", "left")
               .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct())
    renamed = connected_components(between).select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = (component.join(renamed, F.col("label") == F.col("old"), "left")
             .select("node", F.coalesce("new", "label").alias("label")))
    single = (renamed.join(component.select("node"), F.col("old") == F.col("node"), "left_anti")
              .select(F.col("old").alias("node"), F.col("new").alias("label")))
    return written_table(known.union(single))


def could_link(n, m, bits, other_bits, percent: int):
    """Whether sets of sizes n and m with these bitmaps can be similar: what one bitmap lacks bounds the overlap."""
    def only(a, b):
        terms = [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(BITMAP // 64)]
        return sum(terms[1:], terms[0])
    overlap = F.least(n - only(bits, other_bits), m - only(other_bits, bits))
    return (100 + percent) * overlap >= percent * (n + m)


def star_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of hubs and members of other components that could be links, each of them once; after them a
    hub has nobody left to meet in its bucket."""
    hub = rows.where("is_hub").select("key", *[F.col(c).alias(f"hub_{c}") for c in ("cid", "label", "n", "bands", "bits")])
    # a pair is met in the bucket of its first common key, and from one side only where both are hubs
    once = ((F.array_min(F.array_intersect("bands", "hub_bands")) == F.col("key"))
            & (~F.col("is_hub") | (F.col("hub_cid") < F.col("cid"))))
    met = (hub.join(rows, "key").where(F.col("label") != F.col("hub_label"))
           .where(could_link(F.col("n"), F.col("hub_n"), F.col("bits"), F.col("hub_bits"), percent)).where(once))
    return met.select(F.col("hub_cid").alias("a"), F.col("cid").alias("b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         percent: int = 75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each group (the one with the smallest id), all columns as they were.

    Rows of a group that repeat its smallest id count as one; texts with an empty set all stay.  Decisions go by id;
    where rows with one id are decided differently, the set of the text tells them apart.  The ids are sent to the
    scan up to ``broadcast_rows`` of them and joined by a shuffle beyond that.
    """
    found = written_table(near_duplicates(docs, id_col, text_col, width, percent, broadcast_rows))
    full = F.col("cid").isNotNull()
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(full & ~stays).alias("go"),
                                      F.count_if(full & stays).alias("stay"))
    all_go = F.col("rows") == F.col("go")
    unsure = ~all_go & ((F.col("go") > 0) | (F.col("stay") > 1))
    name, cid = spare_name(docs, "touched"), spare_name(docs, "set")
    touched = written_table(ids.where(all_go | unsure).select(F.col("doc_id").alias(name), unsure.alias("unsure")))

    def sent(rows: DataFrame) -> DataFrame:
        rows = rows.select(name)
        return F.broadcast(rows) if rows.limit(broadcast_rows + 1).count() <= broadcast_rows else rows

    same_id = col(id_col).eqNullSafe(col(name))
    clear = docs.join(sent(touched), same_id, "left_anti")
    doubtful = touched.where("unsure")
    if not doubtful.limit(1).count():
        return clear

    def name_set(text: pd.Series) -> pd.Series:
        sets = [shingle_set(t, width) for t in text]
        return pd.Series([set_id(s) if len(s) else None for s in sets])

    rows = docs.join(sent(doubtful), same_id, "left_semi").withColumn(cid, F.pandas_udf(name_set, "binary")(col(text_col)))
    kept = found.where(full & stays).select(F.col("doc_id").alias(name), F.col("cid").alias("kept_set")).distinct()
    chosen = (rows.where(col(cid).isNotNull()).dropDuplicates([id_col, cid])
              .join(kept, same_id & (col(cid) == F.col("kept_set")), "left_semi"))
    return clear.union(chosen.union(rows.where(col(cid).isNull())).select(*[col(c) for c in docs.columns]))
