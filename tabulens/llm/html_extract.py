"""Main-text extraction as a maximum-scoring subsequence.

A page becomes a sequence of markup and text nodes.  Words score positive and
tags negative; the weights are log odds of lying inside the article, learned
from labelled pages (pages that mark their article with ``article`` or ``main``
label themselves) on top of fixed priors.  One linear scan finds the contiguous
region with the best total; its text, block by block, is the result.  Elements
that are never main text (menus, forms, adverts, comments, scripts, ...) score
negative and are left out where they lie inside the region.  Inside a marked
article, headings and paragraphs are never furniture by their class or id; other
elements are scored by the words of each class or id, with fixed priors plus the
log odds of standing outside the article of labelled pages; an id that repeats
the words of the element's own heading is a link target and says nothing.
Tags are read as browsers read them: a quote opens a value only right after an
equals sign; a quote that nothing closes belongs to the value up to the next
white space or end of the tag.  Time is linear in the page, however deep.

The labelled sample is the only bounded input (``sample_pages``, spread evenly
by a hash of the id); extraction reads every page whole.

Defined cases: null or empty html gives an empty text; pages without any words
give an empty text; unclosed and truncated markup is closed by the next block or
the end of the page; repeated rows and ids are extracted row by row; an empty
table gives no rows and is scored with the priors alone; other columns are
ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import col

# Element names and the class, id and role words of page furniture.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "select",
       "title", "noframes", "xmp", "audio", "video")
FURNITURE_TAGS = frozenset("nav footer aside form head menu dialog button fieldset label input".split())
FURNITURE_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar
toolbar form""".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense adbox adsbygoogle sponsor
sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert disclaimer
popup modal overlay sidebar aside widget widgets rail nav navbar navigation menu menus breadcrumb breadcrumbs
pagination pager footer masthead toolbar share sharing social related recommended recommendations newsletter subscribe
subscription signup login register form search comment comments commentlist respond reply replies disqus discussion
skip copyright""".split())
WEAK_WORDS = frozenset("header topbar meta tags".split())
CONTENT_WORDS = frozenset("article post entry content story body main text".split())
KEPT_TAGS = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of classes and ids that furniture bears alone, that it shares with ordinary subjects, and that
# speak of layout only.
OWN_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense adbox adsbygoogle sponsored sponsors
gdpr popup modal overlay sidebar widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager
footer masthead toolbar newsletter signup comment comments commentlist disqus topbar""".split())
SHARED_WORDS = (FURNITURE_WORDS | WEAK_WORDS) - OWN_WORDS - {"header"}
LAYOUT_WORDS = frozenset("""area articles bar block box button buttons col column container floating group icon icons
inline inner item items left link links list outer page panel post posts right row section site slot sticky unit user
users wrap wrapper""".split())
CLASS_PRIORS = (("own", 2.0), ("shared", 1.0), ("layout", 0.0))
FOREIGN_WORD = -1.5                              # once for a value with other words
CLASS_LIMIT = 1.0                                # learned weights move a word by at most this

# The inside of a start tag, state by state: space or slash, or a name with an optional value.
ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
NODE = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?P<rawattr>" + ATTRIBUTES + r")"
    r"(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attr>" + ATTRIBUTES + r")(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
FIRST_HEADING = re.compile(r"(?>\s+|<!--.*?-->|<(?!/?h[1-6]\b|!--)[^>]*>)*+<(h[1-6])\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
LETTERS = re.compile(r"[^\W\d_]+")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")

WORD_PRIOR, TAG_PRIOR, FURNITURE_PRIOR, WEIGHT_LIMIT = 0.5, -0.5, -1.0, 2.0
PRIORS = {"word in article": 0.5, "word outside article": -1.5}


def _words(value: str) -> list[str]:
    """Lower-case words of a class or id, those in camel case included."""
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def _repeats_heading(slug: str, page: str, at: int) -> bool:
    """Whether an id only repeats words of the heading that the element (its content begins at ``at``) opens with."""
    heading = FIRST_HEADING.match(page, at)
    if heading is None:
        return False
    words = set(LETTERS.findall(html_lib.unescape(re.sub(r"<[^>]*>", " ", heading[2])).lower()))
    return set(_words(slug)) <= words


def _attributes(attr: str) -> dict[str, str]:
    """Names in lower case and decoded values of a start tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attr):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m[1].lower(), html_lib.unescape(value) if "&" in value else value)
    return found


def class_score(value: str, weights: dict[str, float]) -> float:
    """How far one class or id speaks for furniture: above 0 it does."""
    words = {w for w in _words(value) if len(w) > 1}
    kinds = {"own": words & OWN_WORDS, "shared": words & SHARED_WORDS}
    if not kinds["own"] and not kinds["shared"]:
        return min(0.0, sum(weights.get(f"class {w}", 0.0) for w in words))
    kinds["layout"] = words & LAYOUT_WORDS - kinds["own"] - kinds["shared"]
    foreign = words - kinds["own"] - kinds["shared"] - kinds["layout"]
    score = sum(prior * len(kinds[k]) for k, prior in CLASS_PRIORS) + (FOREIGN_WORD if foreign else 0.0)
    return score + sum(weights.get(f"class {w}", 0.0) for w in words)


def _is_furniture(name: str, attr: str, in_article: bool, page: str = "", at: int = 0,
                  weights: dict[str, float] | None = None) -> bool:
    if name in FURNITURE_TAGS:
        return True
    if name == "header":
        return not in_article
    if name in KEPT_TAGS or not attr or attr.isspace():
        return False
    found = _attributes(attr)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if in_article or name == "article":          # an article element may be a reader's comment or a teaser
        if name in HEADINGS or name == "p":
            return False
        if any(class_score(value, weights or {}) > 0 for value in found.get("class", "").split()):
            return True
        slug = found.get("id", "")
        return class_score(slug, weights or {}) > 0 and not _repeats_heading(slug, page, at)
    for value in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = set(_words(value))
        if words & FURNITURE_WORDS or (words & WEAK_WORDS and not words & CONTENT_WORDS):
            return True
    return False


class OpenElements:
    """The open elements that matter: blocks and furniture.

    Counters by name answer whether an element is open, and every entry knows its block, so no step walks the stack
    but to close elements.  ``forget_furniture`` leaves its entries behind; they are void by their ``era``.
    """

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, str, int]] = []      # name, furniture, article, block, era
        self.count: dict[str, int] = {}
        self.own: dict[str, int] = {}                                # furniture of this era by name
        self.article = self.furniture = self.era = 0

    def push(self, name: str, own: bool, article: bool):
        block = name if name in BLOCKS else self.block()
        self.stack.append((name, own, article, block, self.era))
        self.count[name] = self.count.get(name, 0) + 1
        self.article += article
        if own:
            self.own[name] = self.own.get(name, 0) + 1
            self.furniture += 1

    def pop(self) -> str | None:
        """Name of the element that was closed; None for a void entry."""
        name, own, article, _, era = self.stack.pop()
        if own and era != self.era:
            return None
        self.count[name] -= 1
        self.article -= article
        if own:
            self.own[name] -= 1
            self.furniture -= 1
        return name

    def top(self) -> str | None:
        while self.stack and self.stack[-1][1] and self.stack[-1][4] != self.era:
            self.stack.pop()
        return self.stack[-1][0] if self.stack else None

    def block(self) -> str:
        return self.stack[-1][3] if self.top() else "body"

    def forget_furniture(self):
        for name, n in self.own.items():
            self.count[name] -= n
        self.own, self.furniture, self.era = {}, 0, self.era + 1

    def close(self, name: str):
        if self.count.get(name):
            while self.pop() != name:
                pass


def page_nodes(page: str, weights: dict[str, float] | None = None):
    """Nodes of a page: (kind, name or text, block name, article flag, furniture flag), in page order.

    ``kind`` is "open", "close" or "text".  The article flag is True inside ``article`` or ``main``.  A furniture
    element reaches to its end tag; one that is never closed reaches to the next article or main heading.
    """
    opened = OpenElements()
    for m in NODE.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], opened.block(), opened.article > 0, opened.furniture > 0
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if not m["close"]:
            if name in VOID or m["attr"].endswith("/") and not m["attr"].endswith("=/"):
                yield "open", name, "", opened.article > 0, opened.furniture > 0
                continue
            own = _is_furniture(name, m["attr"], opened.article > 0, page, m.end(), weights)
            if name in ("article", "main") and not own and not opened.article and opened.furniture:
                opened.forget_furniture()
            if name == "p" or name == "li":      # an open paragraph or item ends where the next begins
                while opened.top() == "p":
                    opened.pop()
                if name == "li" and opened.top() == "li":
                    opened.pop()
            if name in BLOCKS or own:
                opened.push(name, own, name in ("article", "main") and not own)
            yield "open", name, "", opened.article > 0, opened.furniture > 0
        else:
            yield "close", name, "", opened.article > 0, opened.furniture > 0
            opened.close(name)


def class_places(page: str):
    """(word, inside the article) of the classes and ids of a page's elements."""
    depth = 0
    for m in NODE.finditer(page):
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            depth = max(0, depth - (name in ("article", "main")))
        else:
            found = _attributes(m["attr"]) if m["attr"] else {}
            for w in set(_words(f"{found.get('class', '')} {found.get('id', '')}")):
                yield w, depth > 0
            depth += name in ("article", "main")


def node_features(kind: str, name: str, block: str, article: bool, furniture: bool, marked: bool) -> list[str]:
    """Feature names of one node; ``marked`` pages tell where their article is."""
    if kind == "text":
        where = [("word in article" if article else "word outside article")] if marked else []
        return [f"word in {block}", *where]
    return [f"{kind} {name}"]


def unit_weight(weights: dict[str, float], node, marked: bool) -> float:
    """Score of one word of a text node, of one tag, or of a whole piece of furniture (which is left out anyway)."""
    if node[4]:
        return FURNITURE_PRIOR if node[0] == "text" else 0.0
    learned = sum(weights.get(f, 0.0) + PRIORS.get(f, 0.0) for f in node_features(*node, marked))
    return WORD_PRIOR + learned if node[0] == "text" else min(0.0, TAG_PRIOR + learned)


def node_scores(nodes: list, weights: dict[str, float], cache: dict) -> list[float]:
    """Scores of a page's nodes; ``cache`` keeps the unit weights of the node kinds met so far."""
    marked = any(n[3] for n in nodes)
    scores = []
    for node in nodes:
        kind, name, block, article, furniture = node
        key = (kind, block if kind == "text" else name, article, furniture, marked)
        unit = cache.get(key)
        if unit is None:
            unit = cache[key] = unit_weight(weights, node, marked)
        scores.append(unit * len(name.split()) if kind == "text" and not furniture else unit)
    return scores


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, by one linear scan; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str, weights: dict[str, float], cache: dict | None = None) -> str:
    """The blocks of the best region, joined by one line feed."""
    nodes = list(page_nodes(page, weights))
    lo, hi = best_region(node_scores(nodes, weights, {} if cache is None else cache))
    blocks, run = [], []

    def flush():
        text = " ".join(html_lib.unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for kind, name, block, article, furniture in nodes[lo:hi]:
        if kind == "text":
            if not furniture:
                run.append(name)
        elif name in BLOCKS:
            flush()
        elif name == "br":
            run.append(" ")
    flush()
    return "\n".join(blocks)


def learn_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
                  sample_pages: int = 2000, least: int = 20) -> dict[str, float]:
    """Log odds of features inside against outside the marked article, from about ``sample_pages`` marked pages.

    Features seen fewer than ``least`` times keep their prior, so the model is bounded by the sample.
    """
    page = col(html_col)
    marked = pages.where(page.rlike(r"(?i)<(article|main)[\s>]"))
    total = marked.count()
    if not total:
        return {}
    share = min(1.0, sample_pages / total)
    sample = marked.where(F.pmod(F.xxhash64(col(id_col)), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))

    def count(frames):
        for frame in frames:
            seen: dict[str, list[int]] = {}
            for text in frame["page"]:
                for node in page_nodes(text):
                    if node[4]:
                        continue
                    n = len(node[1].split()) if node[0] == "text" else 1
                    for f in node_features(*node, True):
                        seen.setdefault(f, [0, 0])[0 if node[3] else 1] += n
                for word, inside in class_places(text):
                    seen.setdefault(f"class {word}", [0, 0])[0 if inside else 1] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in seen.items()], columns=["feature", "inside", "outside"])

    rows = (sample.select(page.alias("page")).mapInPandas(count, "feature string, inside long, outside long")
            .groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
            .where(F.col("i") + F.col("o") >= least).collect())
    words = [r for r in rows if r["feature"].startswith("word")]
    classes = [r for r in rows if r["feature"].startswith("class ")]
    tags = [r for r in rows if not r["feature"].startswith(("word", "class "))]
    weights = {}
    for r in classes:                            # log odds of standing outside, even odds as the prior
        odds = math.log((r["o"] + 1) / (r["i"] + 1))
        weights[r["feature"]] = max(-CLASS_LIMIT, min(CLASS_LIMIT, odds))
    for group in (words, tags):
        inside, outside = sum(r["i"] for r in group) + 2, sum(r["o"] for r in group) + 2
        for r in group:
            odds = math.log((r["i"] + 1) / inside) - math.log((r["o"] + 1) / outside)
            weights[r["feature"]] = max(-WEIGHT_LIMIT, min(WEIGHT_LIMIT, odds))
    # a tag costs at most twice its prior; the blocks words stand in only shade their base score; where the article is marked, the mark decides
    for f in weights:
        if f.startswith("class "):
            continue
        if not f.startswith("word"):
            weights[f] = max(TAG_PRIOR, weights[f])
        elif f.startswith("word in ") and f != "word in article":
            weights[f] = max(-0.4, min(0.4, weights[f]))
    return weights


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url",
                      weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url and main text of every page; weights are learned from the same pages unless given."""
    learned = learn_weights(pages, html_col, id_col) if weights is None else weights

    @F.pandas_udf("string")
    def extract(page: pd.Series) -> pd.Series:
        cache: dict = {}
        return page.map(lambda p: main_text(p, learned, cache) if p else "")

    return pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), extract(col(html_col)).alias("text"))
