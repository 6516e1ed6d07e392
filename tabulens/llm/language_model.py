"""Interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays.

Counting: every task turns its texts into 64-bit word hashes, counts the bigrams
of some millions of tokens at a time and sends one packed array per key range.
Each range is merged by one task, which writes it as a sorted array and passes
on partial statistics of the words in it; these are merged by ranges of word
hashes into a second set of sorted arrays.  A hot word or bigram is one entry
per packed array, so no range is larger than another.

Scoring: workers memory-map the arrays and look up the sorted distinct bigrams
and words of some hundred documents at a time.

The arrays lie in the shared folder of ``spark.checkpoint.dir`` and are read by
their path, so that folder has to be one that workers can map (a ``file:``
path of a shared file system); another kind raises ``ValueError``.  A repeated
task replaces its files with equal ones.

Defined cases: a null or empty text is its end token; null ids belong to the
training rows; repeated rows count and score one by one; without training rows
every token has the uniform probability 1; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, parts_for, text_bytes
from tabulens.session import checkpoint_dir

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))    # no word holds a blank
WORD_FIELDS = ("count", "ones", "twos", "more", "before")


# ---------------------------------------------------------------- arrays

def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Number of the key range: the top ``bits`` bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def range_slices(sorted_keys: np.ndarray, bits: int):
    """(range, slice) of the ranges that occur in sorted keys."""
    numbers = range_of(sorted_keys, bits)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(numbers))):
        yield int(numbers[a]), slice(a, b)


def packed(x: np.ndarray) -> bytes:
    """Bytes of an unsigned array in its smallest type, the type first."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
    return kind.char.encode() + x.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=data[:1].decode(), offset=1)


def save(folder: str, name: str, x: np.ndarray) -> None:
    """Write an array whole or not at all."""
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, x)
    os.replace(own, f"{folder}/{name}.npy")


class SortedArrays:
    """Memory-mapped arrays of a folder, found by sorted keys."""

    def __init__(self, folder: str, kind: str, bits: int, fields: tuple[str, ...]):
        self.folder, self.kind, self.bits, self.fields = folder, kind, bits, fields
        self.open: dict[str, np.ndarray | None] = {}

    def array(self, number: int, field: str) -> np.ndarray | None:
        name = f"{self.folder}/{self.kind}-{number}-{field}.npy"
        if name not in self.open:
            self.open[name] = np.load(name, mmap_mode="r") if os.path.exists(name) else None
        return self.open[name]

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """The fields of sorted keys; 0 where a key is not there."""
        out = {f: np.zeros(len(keys), dtype=np.int64) for f in self.fields}
        for number, part in range_slices(keys, self.bits):
            own = self.array(number, "keys")
            if own is None or not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[part]), len(own) - 1)
            there = own[at] == keys[part]
            for f in self.fields:
                out[f][part] = np.where(there, self.array(number, f)[at], 0)
        return out


# ---------------------------------------------------------------- counting

def tokens(text: str | None) -> np.ndarray:
    """Word hashes of a text (A-Z in lower case, words at ASCII white space), then the end token."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    digest = xxhash.xxh3_64_intdigest
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = [digest(w) for w in words]
    out[-1] = END
    return out


def contexts(second: np.ndarray) -> np.ndarray:
    """The word before each token; a start mark at the beginning and after each end."""
    first = np.empty_like(second)
    first[0] = START
    first[1:] = np.where(second[:-1] == END, START, second[:-1])
    return first


def count_bigrams(texts: DataFrame, bits: int, flush: int) -> DataFrame:
    """Packed bigram counts (range, words, first, second, counts) of the texts, ``flush`` tokens at a time."""

    def counted(parts):
        second = np.concatenate(parts)
        first = contexts(second)
        keys, index, counts = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
        first, second = first[index], second[index]
        rows = []
        for number, part in range_slices(keys, bits):
            words = np.unique(np.concatenate([first[part], second[part]]))
            rows.append((number, words.tobytes(), packed(np.searchsorted(words, first[part])),
                         packed(np.searchsorted(words, second[part])), packed(counts[part])))
        return pd.DataFrame(rows, columns=["range", "words", "first", "second", "counts"])

    def run(frames):
        parts, size = [], 0
        for frame in frames:
            for text in frame["text"]:
                parts.append(tokens(text))
                size += len(parts[-1])
                if size >= flush:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    return texts.mapInPandas(run, "range long, words binary, first binary, second binary, counts binary")


def merge_bigrams(folder: str, word_bits: int):
    """Merges one range: writes its arrays, returns partial word statistics by range of word hashes.

    A row of range -1 holds the number of bigrams seen once, twice, three and four times.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["range"].iloc[0])
        firsts, seconds, counts = [], [], []
        for r in frame.itertuples(index=False):
            words = np.frombuffer(r.words, dtype=np.uint64)
            firsts.append(words[unpacked(r.first)])
            seconds.append(words[unpacked(r.second)])
            counts.append(unpacked(r.counts).astype(np.int64))
        first, second, count = map(np.concatenate, (firsts, seconds, counts))
        keys = pair_keys(first, second)
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first, second, count = first[order][starts], second[order][starts], np.add.reduceat(count[order], starts)
        save(folder, f"pair-{number}-keys", keys[starts])
        # most counts are small: one byte each, and a short sorted list of the others
        save(folder, f"pair-{number}-small", np.minimum(count, 255).astype(np.uint8))
        big = count >= 255
        save(folder, f"big-{number}-keys", keys[starts][big])
        save(folder, f"big-{number}-count", count[big])

        words, where = np.unique(np.concatenate([first, second]), return_inverse=True)
        a, b = where[:len(first)], where[len(first):]
        total = lambda at, x: np.bincount(at, weights=x, minlength=len(words)).astype(np.int64)
        fields = [total(b, count), total(a, count == 1), total(a, count == 2), total(a, count > 2),
                  total(b, np.ones(len(b)))]
        at = np.searchsorted(words, START)
        if at < len(words) and words[at] == START:          # texts begun, in place of a count it has not got
            fields[0][at] = count[first == START].sum()
        rows = [(n, words[part].tobytes(), *(packed(f[part]) for f in fields), 0, 0, 0, 0)
                for n, part in range_slices(words, word_bits)]
        rows.append((-1, b"", *([b""] * 5), *(int((count == i).sum()) for i in range(1, 5))))
        return pd.DataFrame(rows, columns=["range", "words", *WORD_FIELDS, "t1", "t2", "t3", "t4"])

    return run


def merge_words(folder: str):
    """Merges the statistics of one range of words and returns its totals."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["range"].iloc[0])
        names = ["tokens", "words", "pairs", "t1", "t2", "t3", "t4", "u1", "u2", "u3", "u4"]
        if number < 0:
            sums = [int(frame[f"t{i}"].sum()) for i in range(1, 5)]
            return pd.DataFrame([[0, 0, 0, *sums, 0, 0, 0, 0]], columns=names)
        words = np.concatenate([np.frombuffer(w, dtype=np.uint64) for w in frame["words"]])
        order = np.argsort(words)
        words = words[order]
        starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        words, fields = words[starts], {}
        for f in WORD_FIELDS:
            x = np.concatenate([unpacked(v).astype(np.int64) for v in frame[f]])[order]
            fields[f] = np.add.reduceat(x, starts)
            x = fields[f]
            save(folder, f"word-{number}-{f}", x.astype(np.min_scalar_type(int(x.max()))))
        save(folder, f"word-{number}-keys", words)
        real = words != START
        before = fields["before"][real]
        return pd.DataFrame([[int(fields["count"][real].sum()), int(real.sum()), int(before.sum()), 0, 0, 0, 0,
                              *(int((before == i).sum()) for i in range(1, 5))]], columns=names)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; half a count where the counts of counts do not give one."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def map_folder(spark) -> str:
    """A new folder for arrays in the shared folder, as a path that workers can open."""
    at = urlparse(checkpoint_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays need a shared folder that workers can map, not {at.scheme}:")
    path = f"{at.path.rstrip('/')}/arrays/{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def train(texts: DataFrame, total_bytes: int, range_bytes: int = 16 << 20, flush: int = 4_000_000) -> dict:
    """Count the bigrams of ``texts`` (column text) into a new folder; returns what scoring needs to know.

    One range of bigrams stands for about ``range_bytes`` of text.  Only totals come to the driver, one row a range.
    """
    folder = map_folder(texts.sparkSession)
    bits = (parts_for(total_bytes, range_bytes) - 1).bit_length()
    word_bits = max(0, bits - 2)
    statistics = (count_bigrams(texts.select("text"), bits, flush).groupBy("range")
                  .applyInPandas(merge_bigrams(folder, word_bits),
                                 "range long, words binary, " + ", ".join(f"{f} binary" for f in WORD_FIELDS)
                                 + ", t1 long, t2 long, t3 long, t4 long"))
    names = ["tokens", "words", "pairs", "t1", "t2", "t3", "t4", "u1", "u2", "u3", "u4"]
    rows = (statistics.groupBy("range").applyInPandas(merge_words(folder), ", ".join(f"{n} long" for n in names))
            .collect())
    total = {n: sum(r[n] for r in rows) for n in names}
    return {"folder": folder, "bits": bits, "word_bits": word_bits, "tokens": total["tokens"], "words": total["words"],
            "pairs": total["pairs"], "bigram_discounts": discounts(*(total[f"t{i}"] for i in range(1, 5))),
            "word_discounts": discounts(*(total[f"u{i}"] for i in range(1, 5)))} | {
                f"u{i}": total[f"u{i}"] for i in range(1, 5)}


# ---------------------------------------------------------------- scoring

def by_class(x: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.choose(np.minimum(x, 3), [0.0, *d])


class Scorer:
    """Log10 probabilities of tokens from the memory-mapped arrays."""

    def __init__(self, model: dict):
        self.model = model
        self.pairs = SortedArrays(model["folder"], "pair", model["bits"], ("small",))
        self.big = SortedArrays(model["folder"], "big", model["bits"], ("count",))
        self.words = SortedArrays(model["folder"], "word", model["word_bits"], WORD_FIELDS)

    def score(self, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the model, log10 of the base, and whether it was seen in training."""
        m = self.model
        vocabulary = m["words"] + 1
        first = contexts(second)
        words, at = np.unique(np.concatenate([second, [START]]), return_inverse=True)
        found = self.words.find(words)
        b = at[:-1]
        a = np.concatenate([[at[-1]], b[:-1]])
        a = np.where(first == START, at[-1], a)

        # lowest order: how many different words a word follows, interpolated with the uniform distribution
        d = m["word_discounts"]
        if m["pairs"]:
            left_over = d[0] * m["u1"] + d[1] * m["u2"] + d[2] * (m["words"] - m["u1"] - m["u2"])
            lower = (found["before"] - by_class(found["before"], d)).clip(0) + left_over / vocabulary
            lower = lower / m["pairs"]
        else:
            lower = np.full(len(words), 1.0 / vocabulary)

        keys, which = np.unique(pair_keys(first, second), return_inverse=True)
        count = self.pairs.find(keys)["small"]
        over = np.flatnonzero(count == 255)
        if len(over):
            count[over] = self.big.find(keys[over])["count"]
        d = m["bigram_discounts"]
        seen = found["count"]
        weight = d[0] * found["ones"] + d[1] * found["twos"] + d[2] * found["more"]
        held = (count - by_class(count, d)).clip(0)[which]
        total = seen[a]
        p = np.where(total > 0, (held + weight[a] * lower[b]) / np.maximum(total, 1), lower[b])
        base = (seen[b] + 1.0) / (m["tokens"] + vocabulary)
        return np.log10(p), np.log10(base), seen[b] > 0


def language_model_scores(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text",
                          chunk_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, is_training, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    id_type = docs.select(col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"),
                       F.coalesce(is_training, F.lit(True)).alias("is_training"))
    training = rows.where("is_training")
    total_bytes = training.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    model = train(training, total_bytes)

    def run(frames):
        scorer = Scorer(model)
        for frame in frames:
            parts = [tokens(t) for t in frame["text"]]
            sizes = np.array([len(p) for p in parts])
            out = {"n_known": np.zeros(len(parts), dtype=np.int64), "base_score": np.zeros(len(parts)),
                   "score": np.zeros(len(parts))}
            at = 0
            while at < len(parts):
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), chunk_tokens, side="right")))
                own, base, known = scorer.score(np.concatenate(parts[at:upto]))
                text = np.repeat(np.arange(upto - at), sizes[at:upto])
                for name, x in (("score", own), ("base_score", base), ("n_known", known)):
                    out[name][at:upto] = np.bincount(text, weights=x, minlength=upto - at)
                at = upto
            yield pd.DataFrame({"doc_id": frame["doc_id"], "is_training": frame["is_training"], "n_tokens": sizes,
                                "train_tokens": model["tokens"], **out})

    return rows.mapInPandas(run, f"doc_id {id_type}, is_training boolean, n_tokens long, train_tokens long, "
                                 "n_known long, base_score double, score double")
