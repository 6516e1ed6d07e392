"""Quality rules with adaptive thresholds per language and source.

Every text gets a few exact statistics.  Per (language, source) a mergeable
quantile sketch of each derived feature is kept: counts of logarithmic buckets,
1 % wide, which merge by adding counts, so Spark's partial aggregation builds
them and language-wide or global sketches are sums of the finer ones.

Every feature is a rate (symbols a word, characters a word, ...), so fences are
set on its square root, on which the error of a rate counted over n units is
1 / (2 * sqrt(n)) whatever the rate (times the
root of what one event counts).  A group's fence is its median plus ``REACH``
times the distance to its tail quantile (``TAIL``), shrunk towards its language's,
and that towards everything's, as if those added ``shrink`` rows.  A document may
pass the fence by ``ERRORS`` errors: its own over its units, and that of the
group's documents of middle length.  No threshold is a constant of a feature.
Statistics and fences are then joined and filtered.

Nothing is sampled.  A sketch has a few hundred buckets a feature; fences are
joined to the rows without a hint, so any number of groups will do.

Defined cases: a null text has no words and fails the base rules; null language
and null source are groups of their own; repeated rows are judged one by one; an
empty table gives no rows; other columns pass through ``filter_quality``
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import col, spare_name
from tabulens.session import written_table

BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WIDTH = 1.01                       # ratio of neighbouring bucket bounds
ZERO_BUCKET = -(1 << 30)

TAIL, REACH, ERRORS = 0.8, 6.0, 4.0

#: feature -> (what is counted, units it is counted over, least that one event counts, whether low rates are judged too);
#: a repeat is two windows of three words, so six words at a time
RATES = {
    "mean_word": ("word_chars", "n_words", 1, True),
    "symbols_per_word": ("n_symbols", "n_words", 1, False),
    "dup_lines_per_line": ("n_dup_lines", "n_lines", 1, False),
    "repeats_per_word": ("n_repeat_words", "n_words", 6, False),
}
UNITS = ("n_words", "n_lines")
FENCE_NAMES = [*(f"high_{k}" for k in RATES), *(f"low_{k}" for k, v in RATES.items() if v[3]), *UNITS]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    size = len(codes)
    if size == n:
        return 0
    pairs = ids[:-2] * size + ids[1:-1]
    if size > 2_000_000:           # keep the triple's code within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The base statistics, and the number of lines that hold a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()      # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def stats_frame(text: pd.Series) -> pd.DataFrame:
    rows = [text_stats(t) for t in text]
    return pd.DataFrame(rows, columns=[*BASE_STATS, "n_lines"], dtype="int64")


def stats_of(text: Column) -> Column:
    """The statistics of a text column, as a struct."""
    def run(text: pd.Series) -> pd.DataFrame:
        return stats_frame(text)
    return F.pandas_udf(run, ", ".join(f"{c} long" for c in [*BASE_STATS, "n_lines"]))(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """The rates, and the units they are counted over."""
    rates = {k: s[count] / F.greatest(s[units], F.lit(1)) for k, (count, units, _, _) in RATES.items()}
    return rates | {u: s[u].cast("double") for u in UNITS}


def bucket(value: Column) -> Column:
    """Sketch bucket of a value that is not negative."""
    return F.when(value <= 0, ZERO_BUCKET).otherwise(F.ceil(F.log(value) / math.log(WIDTH)).cast("int"))


def sketch(stats: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, feature, bucket, n) of the rows that pass the base rules."""
    rows = stats.where(~base_failed(F.col("stats")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(v).alias("bucket"))
                               for k, v in features(F.col("stats")).items()])).alias("f")
    return (rows.select("lang", "source", each).select("lang", "source", "f.feature", "f.bucket")
            .groupBy("lang", "source", "feature", "bucket").agg(F.count(F.lit(1)).alias("n")))


def sketch_fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: its rows and its fences, from the merged sketches of the rows with that key."""
    merged = sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    within = Window.partitionBy(*keys, "feature")
    upto = F.sum("n").over(within.orderBy("bucket"))
    total = F.sum("n").over(within)
    value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(
        F.pow(F.lit(WIDTH), F.col("bucket").cast("double") - 0.5))
    quantiles = {"low": 1 - TAIL, "mid": 0.5, "high": TAIL}
    q = (merged.select(*keys, "feature", value.alias("v"), upto.alias("upto"), total.alias("total"))
         .groupBy(*keys, "feature")
         .agg(F.max("total").alias("rows"),
              *[F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("v"))).alias(k) for k, p in quantiles.items()]))
    mid, out = F.sqrt("mid"), []
    for name in FENCE_NAMES:
        side, _, feature = name.partition("_")
        mine = F.col("feature") == (name if name in UNITS else feature)
        at = F.col("mid") if name in UNITS else mid + REACH * (F.sqrt(side) - mid)
        out.append(F.max(F.when(mine, at)).alias(name))
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *out)


def shrunk(rows: Column, own: Column, wider: Column, shrink: float) -> Column:
    """A group's fence drawn towards that of the wider group, as if the latter added ``shrink`` rows."""
    return F.when(own.isNull(), wider).otherwise((rows * own + shrink * wider) / (rows + shrink))


def learn_fences(stats: DataFrame, shrink: float = 200.0) -> DataFrame:
    """Fences of every (lang, source) of ``stats`` (columns lang, source, stats), in the struct column ``fences``."""
    sketches = written_table(sketch(stats))
    own, lang, every = (sketch_fences(sketches, keys) for keys in (["lang", "source"], ["lang"], []))
    found = every.collect()                                      # one row
    whole = {n: F.lit(found[0][n] if found else None).cast("double") for n in FENCE_NAMES}
    lang = lang.select(F.col("lang").alias("ll"), *[
        shrunk(F.col("rows"), F.col(n), whole[n], shrink).alias(f"lang_{n}") for n in FENCE_NAMES])
    fences = F.struct(*[shrunk(F.col("rows"), F.col(n), F.col(f"lang_{n}"), shrink).alias(n) for n in FENCE_NAMES])
    return own.join(lang, own["lang"].eqNullSafe(F.col("ll")), "left").select("lang", "source", fences.alias("fences"))


def judged(rows: DataFrame, fences: DataFrame, stats: str, lang: str, source: str, verdict: str) -> DataFrame:
    """``rows`` plus the verdict of base rules and fences (rows of unknown groups have no fences to break)."""
    fl, fs, ff = (spare_name(rows, f"fence_{x}") for x in ("lang", "source", "pair"))
    fences = fences.select(F.col("lang").alias(fl), F.col("source").alias(fs), F.col("fences").alias(ff))
    joined = rows.join(fences, col(lang).eqNullSafe(col(fl)) & col(source).eqNullSafe(col(fs)), "left")
    s, kept = col(stats), ~base_failed(col(stats))
    values = features(s)
    for name, (_, units, lump, both) in RATES.items():
        error = 0.5 * math.sqrt(lump) * F.sqrt(1.0 / F.greatest(s[units], F.lit(1)) + 1.0 / F.greatest(col(ff)[units], F.lit(1.0)))
        root = F.sqrt(values[name])
        kept = kept & F.coalesce(root <= col(ff)[f"high_{name}"] + ERRORS * error, F.lit(True))
        if both:
            kept = kept & F.coalesce(root >= col(ff)[f"low_{name}"] - ERRORS * error, F.lit(True))
    return joined.withColumn(verdict, kept).drop(fl, fs, ff)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", shrink: float = 200.0) -> DataFrame:
    """doc_id, base statistics, base_failed and kept of every document."""
    stats = written_table(docs.select(col(id_col).alias("doc_id"), col(lang_col).alias("lang"),
                                      col(source_col).alias("source"), stats_of(col(text_col)).alias("stats")))
    out = judged(stats, learn_fences(stats, shrink), "stats", "lang", "source", "kept")
    return out.select("doc_id", *[F.col("stats")[c].alias(c) for c in BASE_STATS],
                      base_failed(F.col("stats")).alias("base_failed"), "kept")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                   shrink: float = 200.0) -> DataFrame:
    """The rows of ``docs`` that keep to the rules, all columns as they were."""
    light = written_table(docs.select(col(lang_col).alias("lang"), col(source_col).alias("source"),
                                      stats_of(col(text_col)).alias("stats")))
    fences = written_table(learn_fences(light, shrink))
    stats, verdict = spare_name(docs, "stats"), spare_name(docs, "kept")
    # the row number keeps the optimizer from testing the base rules below the statistics, computing them once more
    row = spare_name(docs, "row")
    counted = docs.select("*", stats_of(col(text_col)).alias(stats), F.monotonically_increasing_id().alias(row))
    out = judged(counted, fences, stats, lang_col, source_col, verdict)
    return out.where(col(verdict)).select(*[col(c) for c in docs.columns])
