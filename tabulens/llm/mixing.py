"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A naive Bayes classifier over hashed words learns the domains from a labelled
table; its log likelihood is scaled to at most ``SHARPNESS`` words, so that short
or mixed texts keep soft memberships.  Every document gets a rate (the expected
number of times it is taken).  The rates are the projected-gradient solution of

    minimise  m' A^-1 m,  m = expected tokens - target tokens by domain,

with rates of at least ``min_rate``, starting from 1 everywhere; A holds, for each
two domains, the tokens weighted by both memberships, so overlapping domains do
not slow the steps down.  In the metric that weighs a rate by its tokens the step
size is 1, so no line search is needed; steps are accelerated, and start afresh
where the miss grows.  A step needs the expected totals only: one aggregation over
a written table of memberships, one row of totals to the driver.  It goes on until
the targets are met or the projected gradient vanishes, that is, until a step
moves next to no rate; the miss that remains then is out of reach of any
nonnegative rates, is returned with the rates and logged.  Rates are a function of
the memberships and the steps taken; every ``FOLDED`` steps those so far are written.

The classifier is the only thing fitted on a sample: about ``sample_rows``
labelled rows, spread evenly by a hash of the id; the model is a table of
``buckets`` weights a domain.

Defined cases: a null or empty text has no tokens, the prior as its membership
and the rate that follows from it; null ids and labels are not learned from;
without labelled rows all memberships are equal; repeated rows get equal rates
and copies; an empty table gives no rows; other columns pass through
``resample`` whatever their names.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, spare_name
from tabulens.session import written_table

SHARPNESS = 20.0
FOLDED = 16                        # steps kept as a fold over the table before rates are written
LOG = logging.getLogger(__name__)
SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text (white space is ASCII); none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def learn_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str,
                  buckets: int, sample_rows: int) -> dict:
    """Log prior and per-bucket log weights of every domain, from ``labelled`` (columns id, domain)."""
    usable = labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).dropDuplicates(["id"])
    total = usable.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))
    # about sample_rows ids by construction, so they are sent to the scan instead of moving texts
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    counts = (texts.select("domain", F.explode(words_of(F.col("text"))).alias("w"))
              .groupBy("domain", bucket_of(F.col("w"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    seen = {d: [0] * buckets for d in domains}
    for r in counts:
        seen[r["domain"]][r["b"]] = r["n"]
    sizes = {d: sum(seen[d]) for d in domains}
    weights = {d: [math.log((n + 0.5) / (sizes[d] + 0.5 * buckets)) for n in seen[d]] for d in domains}
    for b in range(buckets):                    # only differences count; centred sums stay small on long texts
        mean = sum(weights[d][b] for d in domains) / len(domains)
        for d in domains:
            weights[d][b] -= mean
    return {"domains": domains, "weights": weights, "buckets": buckets}


def memberships(docs: DataFrame, model: dict, text_col: str, tokens: str, probs: list[str]) -> DataFrame:
    """``docs`` plus its token count and the posterior of every domain."""
    ids, scores = spare_name(docs, "buckets"), [spare_name(docs, f"score{i}") for i in range(len(probs))]
    out = docs.withColumn(ids, F.transform(words_of(col(text_col)), lambda w: bucket_of(w, model["buckets"])))
    out = out.withColumn(tokens, F.size(col(ids)).cast("long"))
    sharp = F.least(F.lit(1.0), SHARPNESS / F.greatest(col(tokens), F.lit(1)))

    def summed(weights: list[float]) -> Column:
        return F.aggregate(col(ids), F.lit(0.0), lambda a, b: a + F.get(F.lit(weights), b))

    for s, d in zip(scores, model["domains"]):
        out = out.withColumn(s, summed(model["weights"][d]) * sharp)
    top = F.greatest(*[col(s) for s in scores]) if len(scores) > 1 else col(scores[0])
    parts = [F.exp(col(s) - top) for s in scores]
    whole = sum(parts[1:], parts[0])
    return out.withColumns(dict(zip(probs, [p / whole for p in parts]))).drop(ids, *scores)


def stepped(probs: list[Column], steps: list[list[float]], min_rate: float, start: Column | None = None) -> Column:
    """[rate, point of the next gradient] after accelerated projected steps from such a pair, or from rates of 1.

    A step is [momentum, one move a domain].
    """
    one = F.lit(max(1.0, float(min_rate)))
    start = F.array(one, one) if start is None else start
    if not steps:
        return start
    each = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def step(pair, s):
        terms = [p * F.get(s, F.lit(i + 1)) for i, p in enumerate(probs)]
        rate = F.greatest(F.lit(float(min_rate)), F.get(pair, F.lit(1)) - sum(terms[1:], terms[0]))
        return F.get(F.transform(F.array(rate), lambda r: F.array(
            r, r + F.get(s, F.lit(0)) * (r - F.get(pair, F.lit(0))))), F.lit(0))

    return F.aggregate(each, start, step)


def rate_of(probs: list[Column], steps: list[list[float]], min_rate: float) -> Column:
    """The rate after the given steps, from 1."""
    return F.get(stepped(probs, steps, min_rate), F.lit(0))


def fit_rates(table: DataFrame, tokens: str, probs: list[str], weights: list[float], total_tokens: float | None,
              min_rate: float, tolerance: float, precision: float) -> tuple[list[list[float]], float]:
    """Steps of the projected gradient, and the miss that remains: the largest one of a domain, as a share of all tokens.

    They end where that is at most ``tolerance``, or where a plain projected step from the rates would change them by
    less than ``precision`` a token.  ``total_tokens``: tokens after mixing; None for the least total that needs no
    rate below ``min_rate``, or the present total where that is 0.
    """
    p, k = [F.col(c) for c in probs], len(probs)
    named = [c for c in table.columns if c in (tokens, *probs)]
    tok, pair, last = F.col(tokens).cast("double"), spare_name(table, "pair"), spare_name(table, "last")
    first = table.agg(*[F.sum(tok * x).alias(f"t{i}") for i, x in enumerate(p)],
                      *[F.sum(tok * p[i] * p[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    present = np.array([first[f"t{i}"] or 0.0 for i in range(k)])
    whole = present.sum()
    if not whole:
        return [], 0.0
    shared = np.array([[first[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(shared / whole, rcond=1e-9, hermitian=True) / whole
    if total_tokens is None:
        total_tokens = max(min_rate * t / w for t, w in zip(present, weights)) if min_rate else whole
    target = np.array([w * total_tokens for w in weights])

    def miss(totals):
        return float(np.max(np.abs(totals - target)) / total_tokens)

    one = F.lit(max(1.0, float(min_rate)))
    base, folded = table.select(*named, F.array(one, one).alias(pair)), 0
    steps: list[list[float]] = []
    rates = point = present * max(1.0, min_rate)
    worth, pace = math.inf, 1.0
    while miss(rates) > tolerance:
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        steps.append([(pace - 1) / faster, *(inverse @ (point - target)).tolist()])
        if len(steps) - folded > FOLDED:
            done = steps[folded:-1]
            base = written_table(base.select(*named, stepped(p, done, min_rate, F.col(pair)).alias(pair)))
            folded = len(steps) - 1
        # the pair before and after the newest step
        before = base.select(*named, stepped(p, steps[folded:-1], min_rate, F.col(pair)).alias(last))
        after = before.select(*named, last, stepped(p, steps[-1:], min_rate, F.col(last)).alias(pair))
        rate, ahead, was = F.col(pair)[0], F.col(pair)[1], F.col(last)[1]
        row = after.agg(*[F.sum(tok * x * rate).alias(f"r{i}") for i, x in enumerate(p)],
                        *[F.sum(tok * x * ahead).alias(f"y{i}") for i, x in enumerate(p)],
                        F.sum(tok * F.abs(rate - was)).alias("moved")).first()
        rates = np.array([row[f"r{i}"] for i in range(k)])
        now = float((rates - target) @ inverse @ (rates - target))
        if now > worth:                          # momentum overshot: go on from the rates themselves
            steps[-1][0], point, pace = 0.0, rates, 1.0
        else:
            point, pace = np.array([row[f"y{i}"] for i in range(k)]), faster
        worth = now
        if row["moved"] <= precision * whole:
            break
    if miss(rates) > tolerance:
        LOG.warning("targets out of reach: a miss of %.4f of all tokens remains after %d steps", miss(rates), len(steps))
    return steps, miss(rates)


def copies_of(rate: Column, key: list[Column]) -> Column:
    """The rate rounded up or down by a hash of the row's id, so that the expected number of copies is the rate."""
    lot = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1_000_000)) / 1_000_000.0
    return (F.floor(rate) + F.when(lot < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
                  text_col: str = "text", total_tokens: float | None = None, min_rate: float = 0.0,
                  tolerance: float = 1e-3, precision: float = 1e-4, buckets: int = 1024,
                  sample_rows: int = 4000) -> DataFrame:
    """doc_id, n_tokens, p_<domain> of every document, its rate, its number of copies and the remaining miss.

    ``labelled`` has the columns id and domain; ``targets`` are the domains' shares of the tokens.
    """
    domains = list(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    probs = [f"p_{d}" for d in domains]
    model = learn_domains(docs, labelled, domains, id_col, text_col, buckets, sample_rows)
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("_text"))
    table = written_table(memberships(rows, model, "_text", "n_tokens", probs).drop("_text"))
    steps, missed = fit_rates(table, "n_tokens", probs, share, total_tokens, min_rate, tolerance, precision)
    rate = rate_of([F.col(c) for c in probs], steps, min_rate)
    return (table.withColumn("rate", rate).withColumn("copies", copies_of(F.col("rate"), [F.col("doc_id")]))
            .withColumn("target_miss", F.lit(missed)))


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
             text_col: str = "text", total_tokens: float | None = None, min_rate: float = 1.0,
             tolerance: float = 1e-3, precision: float = 1e-3, buckets: int = 1024, sample_rows: int = 4000) -> DataFrame:
    """The rows of ``docs``, each as often as its number of copies says, all columns as they were.

    With the default ``min_rate`` no document is lost: domains that are short repeat theirs.
    """
    domains = list(targets)
    share = [targets[d] / sum(targets.values()) for d in domains]
    model = learn_domains(docs, labelled, domains, id_col, text_col, buckets, sample_rows)
    tokens, times = spare_name(docs, "tokens"), spare_name(docs, "copies")
    probs = [spare_name(docs, f"p{i}") for i in range(len(domains))]
    scored = memberships(docs, model, text_col, tokens, probs)
    table = written_table(scored.select(tokens, *probs))
    steps, _ = fit_rates(table, tokens, probs, share, total_tokens, min_rate, tolerance, precision)
    rate, row = spare_name(scored, "rate"), spare_name(scored, "row")
    out = scored.withColumn(rate, rate_of([col(c) for c in probs], steps, min_rate))
    # the row number keeps the optimizer from moving the test for rows without a copy below the classifier, which it
    # would have to repeat there for every use of a membership
    out = out.select("*", copies_of(col(rate), [col(id_col)]).alias(times), F.monotonically_increasing_id().alias(row))
    copy = spare_name(out, "copy")
    return (out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), col(times).cast("int"))))
            .select(*[col(c) for c in docs.columns]))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, domain): the language of the documents that the label table marks as good and not toxic."""
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id"))
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain")).join(good, "id")
