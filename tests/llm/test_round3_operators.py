"""Token alignment, repeated strings and the Merkle manifest against plain Python versions."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOC_SCHEMA, SMALL, frame


# ---------------------------------------------------------------- 11 alignment

def byte_alphabet():
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def plain_alignment(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet, seen, rows = byte_alphabet(), collections.Counter(), []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(b, pieces)]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            rows.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in a_bytes]), np.cumsum([len(t) for t in b_bytes])
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if max(ends_a[i] - len(a_bytes[i]), ends_b[j] - len(b_bytes[j])) < min(ends_a[i], ends_b[j])] \
            if len(a) < 400 else swept(a, b, ends_a, ends_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        groups = [",".join(str(t) for t, g in zip(a, group_a) if g == k) + "|"
                  + ",".join(str(t) for t, g in zip(b, group_b) if g == k) for k in range(len(cuts))] \
            if len(a) < 400 else None
        seen.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, None if groups is None else
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (a, _), n in seen.items():
        best[a] = max(best[a], n)
    return [(na, nb, ng, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), sha)
            for na, nb, ng, links, sha in rows]


def swept(a, b, ends_a, ends_b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i], b[j]))
        end = min(ends_a[i], ends_b[j])
        i, j = i + (ends_a[i] == end), j + (ends_b[j] == end)
    return out


def check_alignment(got, texts):
    for row, want in zip(got, plain_alignment(texts)):
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum) == want[:6]
        assert want[6] is None or row.groups_sha256 == want[6]


def test_alignment_equals_a_plain_version(spark):
    from tabulens.llm.token_alignment import align_documents
    docs = frame("documents")
    got = align_documents(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3), batch_chars=20_000)
    got = {r.doc_id: r for r in got.collect()}
    check_alignment([got[i] for i in docs.doc_id], docs.text)


def test_alignment_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.token_alignment import align_documents
    texts = ["", " lead", "tail ", "<|endoftext|> <s> <unk>", "▁mark", "naïve déjà vu 中文 🙂", "a\nb\tc  d", "\x00nul", "xx" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = sorted(align_documents(df, with_groups=True).collect(), key=lambda r: r.doc_id)
    check_alignment(got, [*texts, ""])
    assert got[4].n_a == 0 and got[4].groups_sha256 == "" and got[3].n_a > 0
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256
    assert align_documents(empty_docs).collect() == []
    out = align_documents(awkward).collect()
    assert len(out) == 9 and sum(r.doc_id is None for r in out) == 2


# ---------------------------------------------------------------- 12 repeats

def plain_repeats(texts, length):
    raw = [t.encode() if t else b"" for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(spark, texts, **options):
    from tabulens.llm.repeats import remove_repeats
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(df, **options).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, options.get("length", 200))
    return got


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


@pytest.mark.parametrize("most_contexts", [20_000, 1])
def test_repeats_equal_a_plain_version(spark, most_contexts):
    """Shared passages at many offsets, shorter and longer than the limit, overlaps, copies and one within one text."""
    rng = np.random.default_rng(8)
    passage = words(rng, 90)
    texts = [words(rng, 60) + passage[k:k + 190 + 7 * k] + words(rng, 50) for k in range(0, 24)]
    texts += [passage, passage, passage[:199], passage[3:203], words(rng, 40) + "é" * 150 + words(rng, 9) + "é" * 150]
    texts += [words(rng, 30) + passage[:250] + "x" + passage[:250], None, "", "short"]
    got = check_repeats(spark, texts, most_contexts=most_contexts, contexts_a_task=50)
    assert got[24][1] == len(passage) and got[26][1] == 0


def test_repeats_of_plain_runs_and_short_periods(spark):
    rng = np.random.default_rng(9)
    check_repeats(spark, ["a" * 700, "b" * 200, "c" * 201, words(rng, 80) + "a" * 205, "ab" * 300, "ba" * 101,
                          words(rng, 200), "\n" * 450 + words(rng, 20)])


def test_repeats_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.repeats import remove_repeats
    assert remove_repeats(empty_docs).collect() == []
    out = remove_repeats(awkward, with_text=True).collect()
    assert len(out) == 9 and all(r.n_removed == 0 and hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)
    with pytest.raises(ValueError):
        remove_repeats(empty_docs, length=100)


def test_suffix_ranks_order_the_suffixes(spark):
    """Ranks of all suffixes of some strings, with a recursion over several levels and suffixes that tie."""
    from tabulens.llm.repeats import suffix_ranks
    rng = np.random.default_rng(10)
    strings = [rng.integers(1, 3, n).tolist() for n in (1, 2, 3, 40, 57, 90)] + [[1] * 12, [1] * 9, [2, 1] * 8]
    rows = [(s, p, int(v), 1) for s, string in enumerate(strings) for p, v in enumerate(string)]
    got = {(r.seg, r.pos): r["rank"] for r in suffix_ranks(
        spark.createDataFrame(rows, "seg long, pos int, sym long, size int"), 200).collect()}
    suffixes = {(s, p): tuple(strings[s][p:]) for s, p, _, _ in rows}
    ordered = sorted(suffixes.values())
    assert got == {at: ordered.index(x) for at, x in suffixes.items()}


# ---------------------------------------------------------------- 13 manifest

def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, arity=3):
    def spell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return hashed("".join(map(spell, (r[0], r[1], r[2], r[3], text))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([hashed("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = i - i % arity
            out.append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
            i //= arity
        return out

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for s in sources]
    trees = [tree([leaf(r, r[4]) for r in g]) for g in groups]
    crown = tree([t[-1][0] for t in trees])
    out = []
    for place, (g, t) in enumerate(zip(groups, trees)):
        for i, r in enumerate(g):
            way, text = path(t, i) + path(crown, place), r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in way:
                folded = hashed(left + folded + right)
            out.append((r[0], t[0][i], t[-1][0], crown[-1][0], hashed("".join(a + b for a, b in way)), folded,
                        folded == crown[-1][0]))
    return sorted(out, key=repr)


def check_manifest(df, **options):
    from tabulens.llm.merkle import document_manifest, prove
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = prove(document_manifest(df), claimed="tampered", **options).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("leaves", [8192, 7, 1])
def test_manifest_equals_a_plain_version(spark, leaves):
    check_manifest(spark.read.parquet(f"{SMALL}/documents.parquet").repartition(5), leaves_per_part=leaves)


def test_manifest_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.merkle import document_manifest, prove
    check_manifest(awkward, leaves_per_part=2)
    check_manifest(spark.createDataFrame([(4, "a\nb", "en", None, 3)], DOC_SCHEMA))          # a lone leaf is the root
    assert prove(document_manifest(empty_docs), claimed="tampered").collect() == []


def test_multiproof_of_some_leaves_and_of_changed_ones(spark):
    from tabulens.llm.merkle import document_manifest, missing_nodes, prove
    manifest = document_manifest(spark.read.parquet(f"{SMALL}/documents.parquet"))
    some = manifest.leaves.where(F.col("row_id").isin(3, 4, 77, 150))
    proofs = prove(manifest, some).collect()
    assert sorted(r.row_id for r in proofs) == [3, 4, 77, 150] and all(r.verified for r in proofs)
    forged = some.withColumn("claimed", F.unhex(F.sha2(F.lit(b"x"), 256)))
    assert not any(r.verified for r in prove(manifest, forged, claimed="claimed").collect())
    # the union is minimal: whole runs need nothing, one leaf of nine needs two nodes a level
    assert missing_nodes(np.arange(9), 9, 3) == [] and missing_nodes(np.array([4]), 9, 3) == [(0, 3), (0, 5), (1, 0), (1, 2)]
    assert missing_nodes(np.array([0, 1, 2, 9]), 10, 3) == [(1, 1), (1, 2)]


def test_a_task_holds_few_symbols_at_once():
    import pandas as pd
    from tabulens.llm.repeats import stretch_symbols

    class Kept:
        def mapInPandas(self, run, schema):
            return run

    long = list(range(1, 501))
    frame_ = pd.DataFrame({"seg": [7, 8], "sid": [b"a", b"b"], "syms": [long, [3, 4]], "sizes": [[40] * 500, [40, 40]]})
    parts = list(stretch_symbols(Kept(), 74, rows_a_frame=20)(iter([frame_])))
    assert max(map(len, parts)) <= 40
    rows = pd.concat(parts)
    assert rows["seg"].tolist() == [7] * 500 + [8] * 2 and rows["pos"].tolist() == [*range(500), 0, 1]
    assert rows["sym"].tolist() == [*long, 3, 4]
    heads = [np.array(long[i:i + 2], dtype="<i8").tobytes() if i + 2 <= 500 else None for i in range(500)]
    assert rows["head"].tolist()[:500] == heads


def test_sets_leave_a_task_in_small_frames():
    import pandas as pd
    from tabulens.llm.minhash import named_sets, set_id, shingle_set
    texts = [None, "", *[" ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(12)], "a b"]      # about 2 MB
    parts = list(named_sets(iter([pd.DataFrame({"text": texts})]), 5))
    assert len(parts) > 1 and max(map(len, parts)) < len(texts)
    rows = pd.concat(parts)
    sets = [shingle_set(t) for t in texts]
    assert rows["cid"].tolist() == [set_id(s) if len(s) else None for s in sets]
    assert all(np.array_equal(a.view(np.uint64), b) for a, b in zip(rows["shingles"], sets, strict=True))


def test_repeats_give_their_tables_and_shuffles_back(spark):
    """Only the two tables that the result still reads stay on disk; a written table leaves no shuffle files."""
    from pathlib import Path

    from tabulens.llm.common import drop_tables, packed_table
    from tabulens.llm.repeats import remove_repeats
    from tabulens.session import checkpoint_dir
    folder = Path(checkpoint_dir(spark).removeprefix("file:")) / "tables"
    rng = np.random.default_rng(11)
    passage = words(rng, 90)
    texts = [words(rng, 60) + passage[k:k + 300] + words(rng, 50) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = set(folder.glob("*"))
    result = remove_repeats(df)
    left = set(folder.glob("*")) - before
    assert len(left) == 2 and {Path(f.removeprefix("file:")).parent for f in result.inputFiles()} == left
    assert [tuple(r)[1:] for r in result.orderBy("doc_id").collect()] == plain_repeats(texts, 200)

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            manager.getAllFiles()))
    spark.sparkContext._jvm.System.gc()
    held = shuffle_files()
    table_ = packed_table(spark.range(1000, numPartitions=4).repartition(5, "id"))
    assert shuffle_files() <= held
    given = folder.parent / "given"
    table_.write.parquet(str(given))
    drop_tables(spark.read.parquet(str(given)))                    # not a table that the library wrote
    assert spark.read.parquet(str(given)).count() == table_.count() == 1000


def test_texts_go_to_python_in_small_batches(spark):
    """2 MB of texts in one partition: several batches for the packing's tokens; the session's setting stays."""
    from tabulens.llm import packing
    from tabulens.llm.common import BATCH_SETTING, small_batches
    before = spark.conf.get(BATCH_SETTING)
    texts = [f"w{i} " * 700 for i in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def sizes(frames):
        import pandas as pd
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})
    with small_batches(spark):
        batches = [r.n for r in df.mapInPandas(sizes, "n long").collect()]
    assert len(batches) > 1 and sum(batches) == 800
    seen = []

    def written(pieces):
        seen.append(pieces.sparkSession.conf.get(BATCH_SETTING))
        return plain(pieces)
    plain, packing.written_table = packing.written_table, written
    try:
        packed = packing.pack_documents(df).collect()
    finally:
        packing.written_table = plain
    assert seen == ["1m"] and spark.conf.get(BATCH_SETTING) == before
    assert sorted({r.doc_id for r in packed}) == list(range(800))
