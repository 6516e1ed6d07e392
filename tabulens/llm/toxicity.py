"""Toxicity by a weighted finite-state pattern grammar.

Clauses are read as strings of word classes (insult, threat, target, negation,
reporting word, other).  Small transducers mark insults and threats that are
aimed at a target, negated or reported; they are composed into one machine that
reads a clause once in each direction.  What it outputs are matched clauses:
marked insults with the strength of their words, and marked threats; a text
scores by those.  Insults and threats themselves are word classes, not machines:
a lone insult without a target is a match too, a word that is only named
("the word idiot") included, and threats need one of the listed forms.

The insult class is learned: stems and whole words that stand in toxic labelled
texts more often than in clean ones *and* in many different contexts (a word
that is frequent only because one text was copied a thousand times has one
context).  Copies and near copies of a text count once everywhere, so texts and
contexts have the same unit.  Their strength is their log odds.  The weights of the marks are a
logistic regression over the matched clauses of the labelled texts, drawn
towards priors that discount negated and reported clauses.  All come from about
``sample_rows`` labelled rows, spread evenly by a hash of the id; lexicon and
regression are bounded by that sample.  Only texts and labels are read:
language, source and id are no inputs of a score.

Defined cases: null and empty texts match no pattern and get the score of a text
without any; null labels are not learned from; repeated rows are scored one by
one; empty tables work (without labels the fixed priors and word lists decide);
other columns pass through ``drop_toxic`` whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col, spare_name
from tabulens.llm.minhash import near_duplicates
from tabulens.session import written_table

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:\n]+")

# The closed word classes of the grammar, in the languages of the corpus.
THREATS = frozenset("""kill murder shoot stab strangle hang burn destroy hurt beat attack
töten umbringen erschießen verbrennen vernichten verletzen tuer frapper brûler détruire
matar golpear quemar destruir""".split())
TARGETS = frozenset("""you your yourself he him his she her they them their
du dich dir dein deine sie ihr ihn ihm euch tu toi ton ta vous votre il elle ils
tú ti tus usted ustedes él ella ellos vosotros""".split())
NEGATIONS = frozenset("""not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't cannot can't
nicht nie niemals kein keine keinen pas jamais aucun aucune nunca jamás ningún ninguna""".split())
REPORTS = frozenset("""said says say wrote writes called calls claimed quoted reported
sagte sagt schrieb nannte behauptete dit disait écrit appelé
dijo dice escribió llamó""".split())

#: Features of a text's matched clauses and the prior weight of each (own words count, reported ones less).
PRIORS = {"one": -2.5, "nothing matched": -2.0, "strongest insult": 1.0, "insults": 1.0, "insults per word": 0.5,
          "negated": -2.0, "reported": -1.5, "targeted": 0.5, "threats at a target": 4.0, "other threats": 0.5}
RIDGE = 1.0
LEAST_DOCS, LEAST_ODDS, LEAST_EVIDENCE = 5, 1.5, 24.0
LEAST_CONTEXTS, CONTEXTS_PER_DOC = 5, 0.5
SHORTEST_STEM, LONGEST_STEM = 4, 10


# ---------------------------------------------------------------- transducers

@dataclass(frozen=True)
class Transducer:
    """Reads word classes and marks insults and threats.

    ``arcs`` maps (state, class) to (next state, mark or None); ``other`` maps a state to its next state for all
    classes without an arc.  Symbols are (class, marks) pairs; a mark is added to what passes.
    """

    start: int
    arcs: dict
    other: dict

    def step(self, state: int, symbol: tuple[str, frozenset]) -> tuple[int, tuple[str, frozenset]]:
        kind, marks = symbol
        to, mark = self.arcs.get((state, kind), (self.other.get(state, self.start), None))
        return to, (kind, marks | {mark}) if mark else symbol


@dataclass(frozen=True)
class Composed:
    """Composition: the first machine's output is the second one's input; states are pairs."""

    first: object
    second: object

    @property
    def start(self):
        return self.first.start, self.second.start

    def step(self, state, symbol):
        a, out = self.first.step(state[0], symbol)
        b, out = self.second.step(state[1], out)
        return (a, b), out


def window_marker(trigger: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats at most ``reach`` words after a trigger word."""
    arcs, other = {}, {0: 0}
    for left in range(reach + 1):
        arcs[(left, trigger)] = (reach, None)
        if left:
            other[left] = left - 1
            for kind in ("insult", "threat"):
                arcs[(left, kind)] = (left - 1, mark)
    return Transducer(0, arcs, other)


def rest_marker(trigger: str, mark: str) -> Transducer:
    """Marks all insults and threats after a trigger word, to the end of the clause."""
    arcs = {(0, trigger): (1, None), (1, "insult"): (1, mark), (1, "threat"): (1, mark)}
    return Transducer(0, arcs, {0: 0, 1: 1})


FORWARD = Composed(Composed(window_marker("negation", "negated", 3), rest_marker("report", "reported")),
                   window_marker("target", "targeted", 4))
BACKWARD = window_marker("target", "targeted", 4)


def read(machine, symbols: list) -> list:
    state, out = machine.start, []
    for s in symbols:
        state, o = machine.step(state, s)
        out.append(o)
    return out


# ---------------------------------------------------------------- lexicon and scoring

@dataclass
class Grammar:
    """Strengths of the learned insult words (marked ``$``) and stems, and the weights of the features."""

    lexicon: dict = field(default_factory=dict)
    weights: dict = field(default_factory=lambda: dict(PRIORS))
    automaton: object = None

    def strength(self, word: str) -> float:
        """That of the whole word, else of its longest stem."""
        own = self.lexicon.get(word + "$")
        for n in range(min(LONGEST_STEM, len(word)), SHORTEST_STEM - 1, -1):
            if own is not None:
                break
            own = self.lexicon.get(word[:n])
        return own or 0.0

    def kind(self, word: str) -> str:
        return ("insult" if self.strength(word) > 0 else "threat" if word in THREATS
                else "target" if word in TARGETS else "negation" if word in NEGATIONS
                else "report" if word in REPORTS else "other")

    def spots(self, text: str) -> list[int]:
        """Places in a lower-case text where an insult or a threat may begin (one pass over the whole text)."""
        if self.automaton is None:
            import ahocorasick
            self.automaton = ahocorasick.Automaton()
            for w in {f.rstrip("$") for f in self.lexicon} | THREATS:
                self.automaton.add_word(w, len(w))
            self.automaton.make_automaton()
        out = []
        for end, n in self.automaton.iter(text):
            at = end - n + 1
            if not at or not text[at - 1].isalpha():
                out.append(at)
        return out

    def matches(self, text: str | None):
        """(class, word, marks) of the insults and threats in the clauses of a text."""
        if not text:
            return
        text, done = text.lower(), -1
        for at in sorted(self.spots(text)):
            if at < done:
                continue
            begin = max(text.rfind(c, 0, at) for c in ".!?;:\n") + 1
            clause = CLAUSE.match(text, begin)
            done = clause.end()
            words = WORD.findall(clause[0])
            symbols = [(self.kind(w), frozenset()) for w in words]
            ahead = read(FORWARD, symbols)
            back = read(BACKWARD, symbols[::-1])[::-1]
            for word, (kind, marks), (_, more) in zip(words, ahead, back):
                if kind in ("insult", "threat"):
                    yield kind, word, marks | more

    def features(self, text: str | None) -> dict[str, float]:
        """What the regression reads of a text's matched clauses."""
        found = list(self.matches(text))
        out = dict.fromkeys(PRIORS, 0.0) | {"one": 1.0, "nothing matched": float(not found)}
        insults = [(self.strength(w), marks) for kind, w, marks in found if kind == "insult"]
        if insults:
            out["strongest insult"] = max(x for x, _ in insults)
            out["insults"] = math.log1p(len(insults))
            out["insults per word"] = math.log1p(100 * len(insults) / max(1, text.count(" ")))
            for mark in ("negated", "reported", "targeted"):
                out[mark] = sum(mark in marks for _, marks in insults) / len(insults)
        for kind, _, marks in found:
            if kind == "threat":
                aimed = "targeted" in marks and not marks & {"negated", "reported"}
                out["threats at a target" if aimed else "other threats"] = 1.0
        return out

    def score(self, text: str | None) -> float:
        """Probability that the text is toxic."""
        logit = sum(self.weights[k] * v for k, v in self.features(text).items())
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, logit))))


def word_features(text: str) -> set[str]:
    """Whole words (marked ``$``) and their stems."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(w) - 1) + 1))
    return out


def context_features(text: str, wanted: set[str]):
    """(feature, hash of the neighbours) of every wanted feature's occurrences."""
    words = WORD.findall(text.lower())
    for i, w in enumerate(words):
        own = [f for f in (w + "$", *(w[:n] for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(w) - 1) + 1)))
               if f in wanted]
        if own:
            around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
            yield from ((f, around) for f in own)


def log_odds(a: int, b: int, n_a: int, n_b: int) -> float:
    return math.log((a + 0.5) / (n_a + 1)) - math.log((b + 0.5) / (n_b + 1))


def evidence(a: int, b: int, n_a: int, n_b: int) -> float:
    """Likelihood-ratio statistic of a feature's split against that of all texts."""
    share, n = n_a / (n_a + n_b), a + b
    return 2 * sum(x * math.log(x / (n * p)) for x, p in ((a, share), (b, 1 - share)) if x)


def choose_lexicon(toxic: dict, clean: dict, contexts: dict, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Insult words and stems with their strength.

    A stem is taken where it branches: one whose texts nearly all share a single longer form gives way to that.  A
    whole word that is common enough to be judged alone keeps its own strength, which may be none.
    """
    odds = {f: log_odds(n, clean.get(f, 0), n_toxic, n_clean) for f, n in toxic.items()}
    good = {f for f in toxic if odds[f] >= LEAST_ODDS
            and evidence(toxic[f], clean.get(f, 0), n_toxic, n_clean) >= LEAST_EVIDENCE
            and contexts.get(f, 0) >= max(LEAST_CONTEXTS, CONTEXTS_PER_DOC * toxic[f])}
    longest: dict[str, int] = {}
    for f in toxic:
        if len(f) > SHORTEST_STEM:
            longest[f[:-1]] = max(longest.get(f[:-1], 0), toxic[f])
    lexicon = {f: odds[f] for f in good if f.endswith("$") or longest.get(f, 0) < 0.9 * toxic[f]}
    stems = {f for f in lexicon if not f.endswith("$")}
    for f in toxic:
        if f.endswith("$") and f not in lexicon and any(f[:n] in stems for n in range(SHORTEST_STEM, len(f))):
            lexicon[f] = max(0.0, odds[f] - LEAST_ODDS)
    return lexicon


def fit_weights(rows: list[tuple[dict, int]], steps: int = 30) -> dict[str, float]:
    """Logistic regression by damped Newton steps, with a quadratic pull towards the priors."""
    names = list(PRIORS)
    prior = np.array([PRIORS[k] for k in names])
    x = np.array([[r[k] for k in names] for r, _ in rows])
    y = np.array([t for _, t in rows], dtype=float)
    w = prior.copy()

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * RIDGE * np.sum((w - prior) ** 2))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + RIDGE * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step, now, scale = np.linalg.solve(hessian, gradient), loss(w), 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
    return dict(zip(names, w.tolist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int,
                    folds: int, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` labelled texts (row, text, toxic) outside the held-out fold, spread by a hash of the id."""
    usable = (labels.select(col(id_col).alias("id"), col(label_col).alias("toxic"))
              .where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
              .where(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) != fold))
    total = usable.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(math.ceil(share * 1_000_000)))
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null")
    # the chosen ids are about sample_rows by construction, so they are sent to the scan instead of moving texts
    return written_table(texts.join(F.broadcast(chosen), "id").select(
        F.monotonically_increasing_id().alias("row"), "text", F.col("toxic").cast("int").alias("toxic")))


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One text (text, toxic) of each group of near copies; copies with different labels leave one of each label."""
    groups = near_duplicates(sample, "row", "text").select(F.col("doc_id").alias("row"), "component_id")
    kept = (sample.select("row", "toxic").join(groups, "row").groupBy("component_id", "toxic")
            .agg(F.min("row").alias("row")).select("row"))
    # no more rows than the sample has, one number each
    return written_table(sample.join(F.broadcast(kept), "row", "left_semi").select("text", "toxic"))


def learn_grammar(sample: DataFrame) -> Grammar:
    """Lexicon and weights from labelled texts (columns text, toxic) without copies."""

    def counted(features):
        def run(frames):
            seen: Counter = Counter()
            for frame in frames:
                for text in frame["text"]:
                    seen.update(features(text))
            yield pd.DataFrame(list(seen.items()), columns=["feature", "n"])
        return run

    def count(rows: DataFrame, features, least: int = 1) -> dict:
        out = (rows.select("text").mapInPandas(counted(features), "feature string, n long")
               .groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        return {r["feature"]: r["n"] for r in out.collect()}

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Grammar()
    is_toxic, is_clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    toxic = count(is_toxic, word_features, LEAST_DOCS)
    wanted = set(toxic)
    clean = count(is_clean, lambda t: word_features(t) & wanted)
    likely = {f for f, n in toxic.items() if log_odds(n, clean.get(f, 0), n_toxic, n_clean) >= LEAST_ODDS}

    def around(frames):
        for frame in frames:
            yield pd.DataFrame(sorted({x for text in frame["text"] for x in context_features(text, likely)}),
                               columns=["feature", "around"])

    seen = (is_toxic.select("text").mapInPandas(around, "feature string, around string")
            .groupBy("feature").agg(F.countDistinct("around").alias("n")).collect())
    contexts = {r["feature"]: r["n"] for r in seen}
    lexicon = choose_lexicon(toxic, clean, contexts, n_toxic, n_clean)

    def read_all(frames):
        own = Grammar(lexicon)
        for frame in frames:
            rows = [(*own.features(t).values(), int(y)) for t, y in zip(frame["text"], frame["toxic"])]
            yield pd.DataFrame(rows, columns=[f"f{i}" for i in range(len(PRIORS))] + ["toxic"])

    schema = ", ".join(f"f{i} double" for i in range(len(PRIORS))) + ", toxic int"
    # as many rows as the sample has, ten numbers each
    rows = sample.mapInPandas(read_all, schema).collect()
    return Grammar(lexicon, fit_weights([(dict(zip(PRIORS, r)), r["toxic"]) for r in rows]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", fold: int = 0, folds: int = 5, sample_rows: int = 8000) -> Grammar:
    """The grammar learned from labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, fold, folds, sample_rows)
    return learn_grammar(distinct_texts(sample))


def toxicity(text, grammar: Grammar):
    """Score column of a text column."""
    parts = (grammar.lexicon, grammar.weights)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Grammar(*parts)
        for text in texts:
            yield text.map(own.score, na_action=None).astype("float64")

    return F.pandas_udf(run, "double")(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    grammar = fit_toxicity(docs, labels, id_col, text_col)
    held = F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(5)) == 0
    out = docs.select(col(id_col).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"),
                      toxicity(col(text_col), grammar).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    grammar = fit_toxicity(docs, labels, id_col, text_col)
    score = spare_name(docs, "toxicity")
    return (docs.withColumn(score, toxicity(col(text_col), grammar)).where(col(score) < 0.5)
            .select(*[col(c) for c in docs.columns]))
