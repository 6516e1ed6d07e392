"""Alignment of two tokenizers over a corpus.

Tokenizer A is byte-level BPE, B a sentencepiece model that puts a space before the text; both give tokens that cover
the bytes of space + text.  Offsets at which tokens of both end cut them into groups; tokens whose byte ranges overlap
are linked, and a pair of ids counts the documents of the corpus that hold it linked.

*Identity map*: an array gives, for every id of A, the id of B with the same bytes.  Links along the map (all
exact one-to-one groups, and the rare ones inside other groups, so that a document counts once) are counted per task
in a vector as long as A's vocabulary; only pairs off the map enter the pair shuffle, one row per pair and batch of
documents, already counted within it.  Batches then fetch the counts of their own pairs, once per pair, and every
document adds them up from its stored arrays; texts are read and tokenised once and never exchanged.

A batch is bounded by ``batch_chars`` of text, or holds one longer document.  Only the two vectors over A's vocabulary
reach the driver; a pair in every batch has one row per batch, so no key grows with its documents.

Defined cases: null and empty texts, and texts that B does not cover byte by byte (literal U+2581, for one), have
zeros and an empty digest; rows are treated one by one, whatever their ids; extra columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col
from tabulens.llm.packing import encoder
from tabulens.session import written_table

SPACE_MARK = "▁"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class TokenizerPair:
    """Both tokenizers with the bytes of every token; ``ranks`` and ``pieces`` are paths (default: the installed ones)."""

    def __init__(self, ranks: str | None = None, pieces: str | None = None):
        import public_tokenizers as P
        import sentencepiece
        self.a = encoder(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or P.path("piece_bpe_32k.model"))
        a_bytes = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(t) for t in a_bytes], dtype=np.int64)
        self.b_len = np.array([len(t) for t in b_bytes], dtype=np.int64)
        self.b_bytes = b_bytes
        by_bytes = {t: i for i, t in reversed(list(enumerate(b_bytes))) if t}
        self.identity = np.array([by_bytes.get(t, -1) for t in a_bytes], dtype=np.int64)
        # decimal ids with what may follow them, as fixed-width byte strings
        self.a_text = [np.array([f"{i}{end}" for i in range(len(a_bytes))], dtype="S8") for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(b_bytes))], dtype="S8") for end in ",;"]

    def piece_bytes(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of every text; None where there are none to align."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            fits = text and b"".join([self.b_bytes[i] for i in b]) == whole and self.b_len[b].all()
            out.append((np.array(self.a.encode_ordinary(" " + text), dtype=np.int64), np.array(b, dtype=np.int64))
                       if fits else None)
        return out


def align(pair: TokenizerPair, encoded: list[tuple[np.ndarray, np.ndarray]]):
    """Links and groups of some documents at once: every end of a document is an end of tokens of both.

    Returns the link arrays (document, id of A, id of B) and, per document, n_a, n_b, n_groups, n_links and the
    text of its groups.
    """
    n_docs = len(encoded)
    a, b = (np.concatenate([e[side] for e in encoded]) for side in (0, 1))
    sizes = np.array([[len(e[0]), len(e[1])] for e in encoded])
    doc_a, doc_b = (np.repeat(np.arange(n_docs), sizes[:, side]) for side in (0, 1))
    end_a, end_b = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    shared_a = np.isin(end_a, end_b, assume_unique=True)         # this token closes a group
    shared_b = np.isin(end_b, end_a, assume_unique=True)
    ends = np.union1d(end_a, end_b)                              # every stretch between ends is one overlapping pair
    ia, ib = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    group_a = np.cumsum(shared_a) - shared_a                     # group of every token
    group_b = np.cumsum(shared_b) - shared_b
    closed_a, closed_b = np.flatnonzero(shared_a) + 1, np.flatnonzero(shared_b) + 1
    at_a = np.arange(len(a)) + np.concatenate([[0], closed_b])[group_a]     # tokens of B in the groups before
    at_b = np.arange(len(b)) + closed_a[group_b]                            # tokens of A up to and in its group
    text = np.empty(len(a) + len(b), dtype="S8")
    text[at_a] = np.where(shared_a, pair.a_text[1][a], pair.a_text[0][a])
    text[at_b] = np.where(shared_b, pair.b_text[1][b], pair.b_text[0][b])
    widths = np.concatenate([[0], np.cumsum(np.char.str_len(text))])
    whole = text.tobytes().replace(b"\0", b"")
    tokens = np.concatenate([[0], np.cumsum(sizes.sum(1))])
    texts = [whole[widths[s]:widths[e] - 1] for s, e in zip(tokens, tokens[1:])]      # without the last ;
    groups = np.bincount(doc_a[shared_a], minlength=n_docs)
    per_doc = np.column_stack([sizes, groups, sizes.sum(1) - groups])
    return (doc_a[ia], a[ia], b[ib]), per_doc, texts


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
                    pieces: str | None = None, batch_chars: int = 4 << 20, with_groups: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (``groups`` too on demand)."""
    spark = docs.sparkSession
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()
    keep = ["id", *COUNTS, "groups_sha256"] + ["groups"] * with_groups

    def tokenise(frames):
        pair, part, batch = TokenizerPair(ranks, pieces), TaskContext.get().partitionId(), 0
        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            cuts, size = [0], 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= batch_chars:
                    cuts.append(i + 1)
                    size = 0
            for start, end in zip(cuts, [*cuts[1:], len(texts)]):
                if start == end:
                    continue
                batch += 1
                encoded = pair.encode(texts[start:end])
                rows = pd.DataFrame({"id": frame["id"].iloc[start:end].to_numpy(), **{c: 0 for c in COUNTS},
                                     "groups_sha256": "", "keys": b"", "times": b""})
                rows["id"] = frame["id"].iloc[start:end].reset_index(drop=True)
                rows["part"] = (part << 32) + batch
                if with_groups:
                    rows["groups"] = ""
                fits = [i for i, e in enumerate(encoded) if e is not None]
                if fits:
                    (doc, a, b), counts, groups = align(pair, [encoded[i] for i in fits])
                    rows.loc[fits, COUNTS] = counts
                    rows.loc[fits, "groups_sha256"] = [hashlib.sha256(g).hexdigest() for g in groups]
                    if with_groups:
                        rows.loc[fits, "groups"] = [g.decode() for g in groups]
                    size_b = len(pair.b_len)
                    span = len(pair.a_len) * size_b
                    keys, times = np.unique(doc * span + a * size_b + b, return_counts=True)
                    at = np.searchsorted(keys, np.arange(len(fits) + 1) * span)
                    keys = (keys % span).astype("<u4" if span < 2 ** 32 else "<u8")
                    times = times.astype("<u4")
                    rows.loc[fits, "keys"] = [keys[s:e].tobytes() for s, e in zip(at, at[1:])]
                    rows.loc[fits, "times"] = [times[s:e].tobytes() for s, e in zip(at, at[1:])]
                yield rows

    schema = (f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, "
              "times binary, part long" + ", groups string" * with_groups)
    stored = written_table(docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInPandas(tokenise, schema))

    # the driver's copy of both vocabularies: sizes and the identity map
    pair = TokenizerPair(ranks, pieces)
    identity, size_b = pair.identity, len(pair.b_len)
    kind = "<u4" if len(identity) * size_b < 2 ** 32 else "<u8"
    del pair

    def count(frames):
        vector = np.zeros(len(identity), dtype=np.int64)
        for frame in frames:
            for part, own in frame.groupby("part", sort=False):
                keys = np.frombuffer(b"".join(own["keys"]), dtype=kind).astype(np.int64)
                on_map = identity[keys // size_b] == keys % size_b
                vector += np.bincount(keys[on_map] // size_b, minlength=len(vector))
                off, n = np.unique(keys[~on_map], return_counts=True)
                yield pd.DataFrame({"part": part, "pair": off, "n": n})
        used = np.flatnonzero(vector)
        yield pd.DataFrame({"part": pd.array([pd.NA] * len(used), dtype="Int64"), "pair": used * size_b + identity[used],
                            "n": vector[used]})

    local = written_table(stored.select("part", "keys").mapInPandas(count, "part long, pair long, n long"))
    counts = written_table(local.groupBy("pair").agg(F.sum("n").alias("n"), F.max(F.col("part").isNull()).alias("on_map")))
    a_id = F.expr(f"CAST(pair div {size_b} AS INT)")
    # bounded by A's vocabulary: the count of its identity link and its highest count, per id
    by_a = counts.groupBy(a_id.alias("a")).agg(
        F.max("n").alias("best"), F.max(F.when(F.col("on_map"), F.col("n"))).alias("same")).collect()
    best, same = np.zeros(len(identity), dtype=np.int64), np.zeros(len(identity), dtype=np.int64)
    for r in by_a:
        best[r["a"]], same[r["a"]] = r["best"], r["same"] or 0

    wanted = local.where(F.col("part").isNotNull()).select("part", "pair").join(
        counts.where(~F.col("on_map")).select("pair", "n"), "pair")

    def score(key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("pair")
        known, n = got["pair"].to_numpy(), got["n"].to_numpy()
        lengths = own["keys"].map(len).to_numpy() // np.dtype(kind).itemsize
        keys = np.frombuffer(b"".join(own["keys"]), dtype=kind).astype(np.int64)
        times = np.frombuffer(b"".join(own["times"]), dtype="<u4").astype(np.int64)
        a = keys // size_b
        on_map = identity[a] == keys % size_b
        total = np.where(on_map, same[a], 0)
        total[~on_map] = n[np.searchsorted(known, keys[~on_map])]
        doc = np.repeat(np.arange(len(own)), lengths)
        out = own[keep].copy()
        out["n_best"] = sum_by(doc, np.where(total == best[a], times, 0), len(own))
        out["count_sum"] = sum_by(doc, times * total, len(own))
        return out

    result = stored.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(
        score, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
               + ", groups string" * with_groups + ", n_best long, count_sum long")
    return result.select(F.col("id").alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256",
                         *(["groups"] * with_groups))


def sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of ``values`` per document."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, doc, values)
    return out
