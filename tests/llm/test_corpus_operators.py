"""Near-duplicates, neighbours, language model, mixing and the pipeline against plain Python versions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulens.llm.queries import LANGUAGE_TARGETS, QUERIES
from tests.llm.conftest import DOC_SCHEMA, SMALL, frame


# ---------------------------------------------------------------- 5 near-duplicates

def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width
                     else [tuple(words[i:i + width]) for i in range(len(words) - width + 1)])


def components(sets, percent=75):
    """Smallest id reachable over links, by comparing all pairs that share a shingle."""
    parent, seen = {i: i for i in sets}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        for j in {j for s in own for j in seen[s]}:
            both = len(own & sets[j])
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in own:
            seen[s].append(i)
    return {i: root(i) for i in sets}


def assert_components(rows, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), want[i]) for i in sets}


def test_components_of_all_documents(spark):
    docs = frame("documents")
    rows = QUERIES["op5_minhash_dedup"](spark, SMALL).collect()
    assert_components(rows, dict(zip(docs.doc_id, docs.text)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(docs)


def test_components_of_a_group_of_graded_copies(spark):
    """Copies at all distances around the threshold, chains of copies of copies, and exact copies."""
    from tabulens.llm.minhash import near_duplicates
    rng = random.Random(5)
    base = [f"word{rng.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(260):
        words = list(base) if i % 3 else texts[rng.randrange(i)].split() if i else list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    texts |= {i: texts[7] for i in range(260, 300)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    assert_components(near_duplicates(df).collect(), texts)


def test_bitmap_bound_never_excludes_a_link(spark):
    from tabulens.llm.minhash import bitmap, could_link, shingle_set
    rng, rows = random.Random(1), []
    for n in (5, 40, 400, 4000):
        for _ in range(15):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            other = list(words)
            for _ in range(rng.randrange(0, max(2, n // 12))):
                other[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
            both = len(np.intersect1d(a, b))
            rows.append((len(a), len(b), bitmap(a).tolist(), bitmap(b).tolist(), 100 * both >= 75 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "n long, m long, a array<long>, b array<long>, link boolean")
    kept = df.select("link", could_link(F.col("n"), F.col("m"), F.col("a"), F.col("b"), 75).alias("could")).collect()
    assert any(r.link for r in kept) and all(r.could for r in kept if r.link)
    assert any(not r.could for r in kept)


def test_densified_signatures_estimate_similarity():
    from tabulens.llm.minhash import ATTEMPTS, borrow_table, mixed, signature
    tables = [borrow_table(n) for n in ATTEMPTS]
    for size, common in ((8, 6), (60, 40), (2000, 1500)):
        errors = []
        for seed in range(40):
            x = np.unique(mixed(np.arange(2 * size, dtype=np.uint64) + np.uint64(seed * 10**6 + 1)))
            a, b = np.sort(x[:size]), np.sort(x[size - common:2 * size - common])
            same = (signature(a, tables) == signature(b, tables)).mean()
            errors.append(same - common / (2 * size - common))
        assert abs(np.mean(errors)) < 0.08


def test_connected_components_of_a_long_chain(spark):
    from tabulens.llm.components import connected_components
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_near_duplicate_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.minhash import drop_near_duplicates, near_duplicates
    rows = near_duplicates(awkward).collect()
    assert len(rows) == 9
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 4, 3), (4, 4, 3), (None, 1, 5), (5, 1, 5)} <= found
    kept = drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "None"]
    assert near_duplicates(empty_docs).count() == 0 and drop_near_duplicates(empty_docs).count() == 0


# ---------------------------------------------------------------- 6 neighbours

def brute_neighbours(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(int(ids[j]), scores[j]) for j in order]
    return out


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall_and_scores_against_brute_force(spark, folder):
    table = frame("embeddings", folder)
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    want = brute_neighbours(ids, x, 20)
    got = collections.defaultdict(list)
    for r in QUERIES["op6_prefix_forest"](spark, folder).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    where = {v: i for i, v in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - x[where[v]] @ x[where[q]]) < 1e-12 for v, s in found)
        hits += len({v for v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_in_several_blocks_with_unequal_norms(spark):
    from tabulens.llm.prefix_forest import nearest_neighbours
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_neighbours(np.arange(3000), x, 10)
    got = collections.defaultdict(set)
    out = nearest_neighbours(df, F.expr("vec_id % 20 = 0"), k=10, block_rows=700, chunk_rows=60)
    for r in out.collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)


def test_neighbour_edge_cases(spark):
    from tabulens.llm.prefix_forest import nearest_neighbours
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]),
            (6, [2.0, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (8, []),
            (40, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string")
    got = [tuple(r) for r in nearest_neighbours(df, F.expr("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 20, 1.0),
                   (20, 1, 6, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0), (20, 4, 1, 1.0)]
    assert nearest_neighbours(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


# ---------------------------------------------------------------- 8 language model

def plain_model(texts):
    """Token counts and the interpolated modified Kneser-Ney probability of a bigram."""
    uni, bi = collections.Counter(), collections.Counter()
    for t in texts:
        w = (t or "").encode().lower().split() + [None]
        uni.update(w)
        bi.update(zip(["start", *w[:-1]], w))

    def discounts(n):
        if not all(n[i] for i in range(1, 5)):
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in range(1, 4)]

    before = collections.Counter(b for _, b in bi)
    d, u = discounts(collections.Counter(bi.values())), discounts(collections.Counter(before.values()))
    after = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in bi.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1
    free = sum(u[min(c, 3)] for c in before.values()) / (len(uni) + 1)

    def p(a, b):
        lower = (max(before[b] - u[min(before[b], 3)], 0) + free) / len(bi) if bi else 1 / (len(uni) + 1)
        if a not in after:
            return lower
        c = bi[a, b]
        return (max(c - d[min(c, 3)], 0) + sum(d[k] * after[a][k] for k in (1, 2, 3)) * lower) / after[a][0]

    return uni, p


def check_scores(rows, docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    uni, p = plain_model([t for i, t in docs if not held[i]])
    n, v = sum(uni.values()), len(uni)
    want = []
    for i, t in docs:
        w = (t or "").encode().lower().split() + [None]
        want.append((str(i), held[i], len(w), sum(x in uni for x in w), n,
                     sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w),
                     sum(math.log10(p(a, b)) for a, b in zip(["start", *w[:-1]], w))))
    got = [(str(r[0]), *r[1:]) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_of_all_documents(spark):
    docs = frame("documents")
    rows = QUERIES["op8_kneser_ney"](spark, SMALL).collect()
    check_scores(rows, list(zip(docs.doc_id, docs.text)))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_in_several_ranges_equals_one(spark, monkeypatch):
    from tabulens.llm import language_model as lm
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda t, n: train(t, n, range_bytes=20_000, flush=3_000))
    many = {r.doc_id: r.score for r in lm.language_model_scores(docs, F.col("doc_id") % 3 != 0, chunk_tokens=500).collect()}
    monkeypatch.setattr(lm, "train", train)
    one = {r.doc_id: r.score for r in lm.language_model_scores(docs, F.col("doc_id") % 3 != 0).collect()}
    assert many == pytest.approx(one, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    from tabulens.llm import language_model as lm
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a b", "c", ""] * 3)], "doc_id long, text string")
    model = lm.train(docs, 100)
    scorer = lm.Scorer(model)
    words = [lm.tokens(w)[0] for w in ("a", "b", "c", "new")] + [lm.END]
    for context in (lm.tokens("a")[0], lm.tokens("new")[0]):
        p = [10 ** scorer.score(np.array([context, w], dtype=np.uint64))[0][1] for w in words]
        assert sum(p) == pytest.approx(1.0)


def test_language_model_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.language_model import language_model_scores
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    rows = language_model_scores(awkward, fold).select(
        "doc_id", (~F.col("is_training")).alias("h"), "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    check_scores(rows, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert language_model_scores(empty_docs, fold).count() == 0
    none = language_model_scores(awkward, F.lit(False)).collect()
    assert len(none) == 9 and all(r.score == 0 and r.train_tokens == 0 for r in none)


# ---------------------------------------------------------------- 2 mixing

def test_rates_meet_the_targets(spark):
    folder = "/root/testdata/sf0.01"
    table = QUERIES["op2_mixing"](spark, folder).toPandas()
    docs = frame("documents", folder).merge(table, on="doc_id")
    probs = [f"p_{d}" for d in LANGUAGE_TARGETS]
    assert len(table) == 1000 and (table.rate >= 0).all()
    assert np.allclose(table[probs].sum(axis=1), 1)
    expected = {d: (table[f"p_{d}"] * table.n_tokens * table.rate).sum() for d in LANGUAGE_TARGETS}
    for d, share in LANGUAGE_TARGETS.items():
        assert abs(expected[d] / table.n_tokens.sum() - share) < 0.001
    assert (docs.n_tokens == docs.text.map(lambda t: len(t.encode().split()))).all()
    long = docs[docs.n_tokens >= 100]
    assert (long[probs].idxmax(axis=1).str[2:] == long.lang).mean() > 0.9
    assert (table.copies >= np.floor(table.rate)).all() and (table.copies <= np.ceil(table.rate)).all()


def overlapping(spark, rows, seed):
    """Memberships that overlap, as a table and as arrays."""
    rng = np.random.default_rng(seed)
    p, tokens = rng.dirichlet([0.4] * 3, rows), rng.integers(1, 500, rows)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "t long, a double, b double, c double")
    return df, p, tokens


def test_overlapping_memberships_meet_reachable_targets(spark):
    from tabulens.llm.mixing import fit_rates, rate_of
    df, p, tokens = overlapping(spark, 2000, 1)
    steps, missed = fit_rates(df, "t", ["a", "b", "c"], [0.5, 0.3, 0.2], None, 0.0, 1e-4, 1e-6)
    rate = np.array([r[0] for r in df.select(rate_of([F.col(c) for c in "abc"], steps, 0.0)).collect()])
    shares = (tokens * rate) @ p / tokens.sum()
    assert shares == pytest.approx([0.5, 0.3, 0.2], abs=1e-3) and (rate >= 0).all()
    assert missed == pytest.approx(np.abs(shares - [0.5, 0.3, 0.2]).max(), abs=1e-9) and missed <= 1e-4


@pytest.mark.parametrize("target,least,total", [([0.85, 0.1, 0.05], 0.0, 1.0), ([0.98, 0.01, 0.01], 0.0, 1.0),
                                                ([0.8, 0.1, 0.1], 1.0, 1.2)])
def test_projected_gradient_ends_at_the_optimum_of_a_plain_solver(spark, target, least, total):
    """Also where bounds make targets unreachable: the remaining miss is the least one."""
    from tabulens.llm.mixing import fit_rates, rate_of
    df, p, tokens = overlapping(spark, 400, 4)
    goal = np.array(target) * tokens.sum() * total
    steps, missed = fit_rates(df, "t", ["a", "b", "c"], target, float(tokens.sum() * total), least, 1e-3, 1e-3)
    got = np.array([r[0] for r in df.select(rate_of([F.col(c) for c in "abc"], steps, least)).collect()])
    inverse = np.linalg.inv((p * tokens[:, None]).T @ p)
    rate = np.full(400, max(1.0, least))
    for _ in range(30_000):
        rate = np.maximum(least, rate - p @ (inverse @ ((tokens * rate) @ p - goal)))
    best = np.abs((tokens * rate) @ p - goal).max() / goal.sum()
    assert (got >= least).all() and best - 0.025 < missed < best + 0.025
    assert missed == pytest.approx(np.abs((tokens * got) @ p - goal).max() / goal.sum(), abs=1e-9)


def test_mixing_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.mixing import mix_documents, resample
    labelled = spark.createDataFrame([(3, "en"), (5, "de"), (None, "en"), (4, None)], "id long, domain string")
    rows = mix_documents(awkward, labelled, {"en": 0.5, "de": 0.5}).collect()
    assert len(rows) == 9 and all(r.n_tokens == 0 for r in rows if r.doc_id in (1, 2))
    out = resample(awkward, labelled, {"en": 0.5, "de": 0.5})
    assert out.columns == awkward.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, None} and out.count() >= 9
    assert mix_documents(empty_docs, labelled, {"en": 1.0}).count() == 0
    assert resample(empty_docs, labelled.limit(0), {"en": 1.0}).count() == 0


# ---------------------------------------------------------------- pipeline

def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.toPandas()]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.toPandas())
        if i < len(cp.STAGES) - 1:
            assert docs.columns == columns
    before, clean, good, single, mixed, packed = seen
    scores = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert set(clean.doc_id) == {i for i in before.doc_id if not scores[i]}
    groups = components({i: shingles(t) for i, t in zip(good.doc_id, good.text)})
    assert sorted(single.doc_id) == sorted(set(groups.values()))
    assert set(mixed.doc_id) == set(single.doc_id) and len(mixed) >= len(single)
    pieces = packed[packed.piece == 0].doc_id.value_counts()
    assert pieces.to_dict() == mixed.doc_id.value_counts().to_dict()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_pipeline_takes_empty_and_awkward_documents(spark, tmp_path):
    import corpus_pipeline as cp
    for name, rows in (("none", []), ("few", [(1, None, None, None, None), (2, "", "en", "s", 0)])):
        docs = spark.createDataFrame(rows, DOC_SCHEMA)
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert docs.count() == 0
