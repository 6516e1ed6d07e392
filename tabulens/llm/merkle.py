"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null, else its UTF-8 length, ``:`` and its value.  Rows
of one group ascend by id; every ``arity`` consecutive digests become the digest of their hex texts, level by level,
until one is left, the group's subroot.  Subroots, ordered by group (null first, bytewise), give the root likewise.

*Manifest*: leaves get their place by one range exchange of (group, id, leaf, digests) and exact counts of the
partitions before; no window orders a whole group and texts are never exchanged.  Interior nodes are made in blocks of
``arity ** 8`` siblings, so a tree of any size takes a few rounds, each 6,561 times smaller than the one before.

*Proofs*: leaves to prove (all, or any subset) are dealt into leaf partitions of bounded size.  Each partition computes
the minimal union of node coordinates that it lacks (the octopus walk: from the known nodes of a level, the others of
their runs are missing, the runs are known above), all partitions fetch theirs in one join, and each derives its
interior nodes, checks them against the published root and expands the proofs of its leaves locally.

Defined cases: null ids come first, ties on (group, id) ascend by leaf, equal rows take neighbouring places; a null
field is ``-``; an empty table has no rows and no root; extra columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col
from tabulens.session import written_table

TOP = "top"                      # name of the tree over the subroots; trees of groups start with 0 or 1
BLOCK_LEVELS = 8
NODE = "tree string, level int, idx long, digest binary"


def digest_of(parts) -> bytes:
    """SHA-256 of the hex texts of some digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length (null: ``-``)."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                                     for t in texts]), 256))


def missing_nodes(known: np.ndarray, n: int, arity: int) -> list[tuple[int, int]]:
    """(level, index) of the fewest nodes that, with the ``known`` leaves (sorted, unique), give the root of ``n``."""
    out, level = [], 0
    while n > 1:
        runs = np.unique(known // arity)
        children = (runs[:, None] * arity + np.arange(arity)).ravel()
        out += [(level, int(i)) for i in np.setdiff1d(children[children < n], known, assume_unique=True)]
        known, n, level = runs, -(-n // arity), level + 1
    return out


def derive(leaves: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes], arity: int) -> list[dict[int, bytes]]:
    """Known nodes of every level, from the leaves and the fetched nodes up to the single node on top."""
    levels, known = [], dict(leaves)
    while True:
        known.update((i, d) for (level, i), d in fetched.items() if level == len(levels))
        levels.append(known)
        if n <= 1:
            return levels
        known = {r: digest_of(known[i] for i in range(r * arity, min((r + 1) * arity, n)))
                 for r in {i // arity for i in known}}
        n = -(-n // arity)


def siblings(levels: list[dict[int, bytes]], idx: int, arity: int) -> list[tuple[str, str]]:
    """(left, right) hex texts of the others of the run, level by level from leaf ``idx``."""
    out = []
    for known in levels[:-1]:
        run = idx - idx % arity
        out.append(("".join(known[i].hex() for i in range(run, idx)),
                    "".join(known[i].hex() for i in range(idx + 1, run + arity) if i in known)))
        idx //= arity
    return out


def fold(digest: bytes, path: list[tuple[str, str]]) -> bytes:
    """The root that a leaf digest and its siblings lead to."""
    for left, right in path:
        digest = hashlib.sha256((left + digest.hex() + right).encode()).digest()
    return digest


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``idx``, the row's place within its group by ``order``, and the written (group, n) counts.

    One range exchange; a hot group spreads over many partitions, and only one row per (partition, group) is counted.
    """
    salt = F.rand(11).alias("_salt")             # splits runs of equal rows over partitions
    rows = df.select("*", salt).repartitionByRange(group, *order, "_salt").sortWithinPartitions(group, *order, "_salt")
    rows = written_table(rows.drop("_salt").select("*", F.spark_partition_id().alias("_part"),
                                                   F.monotonically_increasing_id().alias("_pos")))
    counted = rows.groupBy("_part", group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_part", group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["_part", group]).withColumn("idx", F.col("_start") + F.col("_pos") - F.col("_first")).drop(
        "_part", "_pos", "_first", "_start")


def height(n: Column, arity: int) -> Column:
    """Levels above the leaves of a tree of ``n``."""
    h, power = F.lit(0), 1
    while power < 2 ** 62:
        h, power = h + (n > F.lit(power)).cast("int"), power * arity
    return h


def interior_nodes(leaves: DataFrame, counts: DataFrame, arity: int) -> DataFrame:
    """All nodes above ``leaves`` (tree, idx, digest); ``counts`` has (tree, n).  Written."""
    size = arity ** BLOCK_LEVELS

    def raise_block(key, frame: pd.DataFrame) -> pd.DataFrame:
        level, n = int(frame["level"].iloc[0]), int(frame["n"].iloc[0])
        known = dict(zip(frame["idx"], frame["digest"]))
        rows = []
        for _ in range(BLOCK_LEVELS):
            if n <= 1:
                break
            known = {r: digest_of(known[i] for i in range(r * arity, min((r + 1) * arity, n)))
                     for r in sorted({i // arity for i in known})}
            n, level = -(-n // arity), level + 1
            rows += [(key[0], level, i, d) for i, d in known.items()]
        return pd.DataFrame(rows, columns=["tree", "level", "idx", "digest"])

    spark = leaves.sparkSession
    out = spark.createDataFrame([], NODE)
    most = counts.agg(F.max("n")).first()[0] or 0
    current = leaves.join(counts, "tree").select("tree", F.lit(0).alias("level"), "idx", "digest", "n")
    level = 0
    while most > 1:
        made = written_table(current.where("n > 1").groupBy("tree", F.expr(f"idx div {size}")).applyInPandas(
            lambda key, frame: raise_block(key, frame), NODE))
        out = out.union(made)
        most, level = -(-most // size), level + BLOCK_LEVELS
        step = F.ceil(F.col("n") / F.lit(size)).cast("long")
        counts = counts.select("tree", step.alias("n"))
        current = made.where(F.col("level") == level).join(counts, "tree").select("tree", "level", "idx", "digest", "n")
    return out


@dataclass
class Manifest:
    """``leaves``: tree, idx, digest and what the rows carry; ``subroots``: tree, n, idx (place), digest;
    ``nodes``: every node of all trees, leaves included; ``root``: digest or None; ``groups``: number of subroots."""
    leaves: DataFrame
    subroots: DataFrame
    nodes: DataFrame
    root: bytes | None
    groups: int
    arity: int


def build_manifest(rows: DataFrame, fields: list[Column], group: Column, row_id: Column, carry: dict[str, Column],
                   arity: int = 3) -> Manifest:
    """Manifest of ``rows``: leaves of ``fields``, trees by ``group``, leaves ordered by ``row_id``."""
    tree = F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))
    base = rows.select(tree.alias("tree"), row_id.alias("row_id"), leaf_digest(fields).alias("digest"),
                       *[c.alias(k) for k, c in carry.items()])
    leaves = written_table(ranked(base, "tree", ["row_id", "digest"]))
    counts = written_table(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    inner = interior_nodes(leaves, counts, arity)
    flat = leaves.select("tree", F.lit(0).alias("level"), "idx", "digest")
    tops = flat.union(inner).join(counts, "tree").where(
        (F.col("idx") == 0) & (F.col("level") == height(F.col("n"), arity))).select("tree", "n", "digest")
    subroots = written_table(ranked(tops.select(F.lit(TOP).alias("top"), F.col("tree").alias("name"), "n", "digest"),
                                    "top", ["name"]).select(F.col("name").alias("tree"), "n", "idx", "digest"))
    groups = subroots.count()
    crown_leaves = subroots.select(F.lit(TOP).alias("tree"), "idx", "digest")
    crown = interior_nodes(crown_leaves, subroots.sparkSession.createDataFrame([(TOP, groups)], "tree string, n long"),
                           arity)
    crown = crown_leaves.select("tree", F.lit(0).alias("level"), "idx", "digest").union(crown)
    top = crown.orderBy(F.desc("level")).where("idx = 0").select("digest").first()
    return Manifest(leaves, subroots, flat.union(inner).union(crown), bytes(top[0]) if top else None, groups, arity)


def prove(manifest: Manifest, chosen: DataFrame | None = None, claimed: str = "digest",
          leaves_per_part: int = 8192) -> DataFrame:
    """Proof and verdict of every chosen leaf (rows of ``manifest.leaves``; default all).

    ``claimed`` names the column with the digest that its holder claims for the leaf; it is folded with the
    siblings and must lead to the published root.  Returns row_id, leaf, subroot, root, proof_sha256, folded_root
    (lowercase hex) and verified.
    """
    arity, root, groups = manifest.arity, manifest.root, manifest.groups
    chosen = manifest.leaves if chosen is None else chosen
    rows = chosen.select("tree", (F.expr(f"idx div {int(leaves_per_part)}")).alias("part"), "idx", "row_id", "digest",
                         F.col(claimed).alias("claimed"))
    parts = rows.groupBy("tree", "part").agg(F.collect_list("idx").alias("known")).join(
        manifest.subroots.select("tree", "n", F.col("idx").alias("place")), "tree")

    def walk(frames):
        for frame in frames:
            out = []
            for tree, part, known, n, place in zip(frame["tree"], frame["part"], frame["known"], frame["n"], frame["place"]):
                out += [(tree, part, tree, -1, n), (tree, part, TOP, -1, place)]     # size and place travel along
                out += [(tree, part, tree, *c) for c in missing_nodes(np.unique(known), n, arity)]
                out += [(tree, part, TOP, *c) for c in missing_nodes(np.array([place]), groups, arity)]
            yield pd.DataFrame(out, columns=["tree", "part", "node_tree", "level", "idx"])

    wanted = written_table(parts.mapInPandas(walk, "tree string, part long, node_tree string, level int, idx long"))
    nodes = manifest.nodes.select(F.col("tree").alias("node_tree"), "level", "idx", "digest")
    fetched = written_table(wanted.where("level >= 0").join(nodes, ["node_tree", "level", "idx"]).select(
        "tree", "part", "node_tree", "level", "idx", "digest").union(
        wanted.where("level < 0").select("tree", "part", "node_tree", "level", "idx", F.lit(None).cast("binary"))))

    def expand(key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        inner, crown, sizes = {}, {}, {}
        for tree, level, idx, digest in zip(got["node_tree"], got["level"], got["idx"], got["digest"]):
            if level < 0:
                sizes[tree] = idx
            else:
                (crown if tree == TOP else inner)[(level, idx)] = bytes(digest)
        levels = derive(dict(zip(own["idx"], map(bytes, own["digest"]))), sizes[key[0]], inner, arity)
        subroot, place = levels[-1][0], sizes[TOP]
        above = derive({place: subroot}, groups, crown, arity)
        if above[-1][0] != root:
            raise ValueError("the fetched nodes do not lead to the published root")
        crown_path = siblings(above, place, arity)
        rows = []
        for idx, digest, claim in zip(own["idx"], own["digest"], own["claimed"]):
            path = siblings(levels, idx, arity) + crown_path
            folded = fold(bytes(claim), path)
            rows.append((bytes(digest).hex(), subroot.hex(), root.hex(),
                         hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest(), folded.hex(), folded == root))
        out = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        out.insert(0, "row_id", own["row_id"].to_numpy())
        return out

    id_type = rows.schema["row_id"].dataType.simpleString()
    return rows.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInPandas(
        expand, f"row_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                "verified boolean")


def document_manifest(docs: DataFrame) -> Manifest:
    """Manifest of a documents table by source; leaves carry the digest of their text without line ends where the
    checksum of the id is even (``tampered``), else their own."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    fields = [col(c) for c in names]
    odd_text = F.translate(col("text"), "\n", "")
    even = F.coalesce(F.crc32(col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, leaf_digest([*fields[:-1], odd_text])).otherwise(leaf_digest(fields))
    return build_manifest(docs, fields, col("source"), col("doc_id"), {"tampered": changed})
