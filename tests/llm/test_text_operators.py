"""Extraction, sharding, archives, quality, toxicity and packing against plain Python versions."""

import base64
import collections
import hashlib
import html
import math
import re
import time
import zlib

import numpy as np
import pytest

from tabulens.llm.queries import QUERIES
from tests.llm.conftest import SMALL, frame

SPACES = " \t\n\r\x0b\x0c"


# ---------------------------------------------------------------- 1 extraction

def plain_article(page):
    """Blocks of the marked article of the given pages (their markup is regular)."""
    inside = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split())
              for b in re.split(r"</?(?:h1|p)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_extracts_the_articles_of_all_pages(spark):
    got = {r.page_id: r for r in QUERIES["op1_html_extract"](spark, SMALL).collect()}
    pages = frame("pages")
    assert len(got) == len(pages)
    for page_id, url, page in zip(pages.page_id, pages.url, pages.html):
        assert got[page_id].text == plain_article(page) and got[page_id].url == url
        assert got[page_id].n_chars == len(got[page_id].text)


def test_extracts_without_a_marked_article(spark):
    from tabulens.llm.html_extract import learn_weights, main_text
    weights = learn_weights(spark.read.parquet(f"{SMALL}/pages.parquet"))
    for page in frame("pages").html[:40]:
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(bare, weights) == plain_article(page)


HARD = """<html><head><title>T</title></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><ul class="menu"><li>a</li><li>b</li></ul><main><article>
<header class="entry-header"><h1>Title &amp; more</h1></header><p>First  para&nbsp;one<p>second <b>bo</b>ld<br>line
<ul><li>i1<li>i2</ul><aside>related stuff</aside><div class="ads">buy now</div><form><input type=text>Sign up</form>
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --><p>Last &lt;b&gt; 5 < 6.</p></article></main>
<section id="comments"><h2>Comments</h2><p>great article I love this so much</p></section><footer>(c)</footer>"""


def test_extraction_leaves_page_furniture_out():
    from tabulens.llm.html_extract import main_text
    assert main_text(HARD, {}) == "Title & more\nFirst para one\nsecond bold line\ni1\ni2\nLast <b> 5 < 6."


SLUGS = """<html><body><header><h1>Site</h1></header><nav>menu</nav><main><article>
<h1 id="cookies-and-consent">Cookies and consent</h1><p id="copyright-law">Copyright law first.</p>
<h2 id="related-work">Related work</h2><p class="notice-text">Others did this.</p>
<section id="discussion"><h2><a href="#discussion">Discussion</a></h2><p>We discuss it.</p>
<h3 id="social-impact">Social impact</h3><p>It matters.</p></section>
<div class="search-results-table"><table><tr><td>one result of the search in full words</td><td>two more results of the search</td></tr></table></div>
<div class="section-header"><h2 id="form">Form</h2></div><ul id="alert-levels"><li>red is the highest level</li></ul><p>And so the article ends with a long last sentence
that the region has to reach.</p><div class="share-buttons">Tweet it</div><div id="relatedPosts"><h3>Read next</h3><p>Another page</p></div>
<div class="ads">Buy</div><div role="search">Find</div><p hidden>Unseen</p><ol class="comment-list"><li>me too</li></ol>
</article></main><footer>(c)</footer></body></html>"""


def test_extraction_keeps_article_parts_whose_ids_hold_furniture_words(spark):
    from tabulens.llm.html_extract import learn_weights, main_text
    want = ["Cookies and consent", "Copyright law first.", "Related work", "Others did this.", "Discussion",
            "We discuss it.", "Social impact", "It matters.", "one result of the search in full words",
            "two more results of the search", "Form", "red is the highest level",
            "And so the article ends with a long last sentence that the region has to reach."]
    weights = learn_weights(spark.read.parquet(f"{SMALL}/pages.parquet"))
    assert main_text(SLUGS, {}).split("\n") == want and main_text(SLUGS, weights).split("\n") == want


FILL = "<p>" + "Plain words of the article go on and on here. " * 3 + "</p>"


def article(inside):
    return f"<html><body><nav>menu</nav><article><h1>Head of the page</h1>{FILL}{inside}{FILL}</article><footer>foot</footer></body></html>"


@pytest.mark.parametrize("tag,text", [
    ("<p title=it's>we don't go</p><p>it isn't far</p>", "we don't go\nit isn't far"),
    ("<p class=\"x'>open to the end</p>", "open to the end"), ("<p a=\"1\"b='2>3'>close together</p>", "close together"),
    ("<p =x>odd sign</p>", "odd sign"), ("<p>see <a href=http://x.y/>the link</a></p>", "see the link"),
    ("<p data-x = '<b>'>spaced out</p>", "spaced out"), ("<svg width=1/><p>after a drawing</p>", "after a drawing"),
    ("<!--><p>after a short comment</p>", "after a short comment"),
    ("<div data-v='&quot;' class='search-results-table'>results stay</div>", "results stay")])
def test_start_tags_are_read_by_the_states_of_html(tag, text):
    from tabulens.llm.html_extract import main_text
    fill = re.sub("<.*?>", "", FILL).strip()
    assert main_text(article(tag), {}) == f"Head of the page\n{fill}\n{text}\n{fill}"


@pytest.mark.parametrize("name", """comments-section comment-body post-comments user-comments reader-comments ad-300x250
cookie-policy-banner page-footer sidebar-left related-articles social-icons""".split())
@pytest.mark.parametrize("element", ["div class", "section id", "article class"])
def test_comments_and_adverts_inside_the_article_go(spark, name, element):
    from tabulens.llm.html_extract import main_text
    tag = element.split()[0]
    assert "said" not in main_text(article(f'<{element}="{name}"><p>what a reader said</p></{tag}>'), {})


def test_class_words_learn_from_labelled_pages(spark):
    """A shared word that labelled articles use inside stays; the same word used outside only goes."""
    from tabulens.llm.html_extract import learn_weights, main_text
    part = article('<div class="social">on society</div>')
    inside = article('<div class="social">on society</div>' * 2)
    outside = '<div class="social">follow us</div>' + article("")
    learned = {k: learn_weights(spark.createDataFrame([(i, "u", page) for i in range(60)],
                                                      "page_id long, url string, html string"))
               for k, page in (("in", inside), ("out", outside))}
    assert learned["in"]["class social"] < 0 < learned["out"]["class social"]
    assert "society" in main_text(part, learned["in"]) and "society" not in main_text(part, learned["out"])


def test_deep_pages_take_linear_time():
    from tabulens.llm.html_extract import main_text
    n = 100_000
    page = "<article>" + "<div>" * n + "<p>words far down the page</p>" + "</div>" * n + "</article>"
    began = time.time()
    assert main_text(page, {}) == "words far down the page"
    main_text("<div>" * n + "<nav><article>x</article>" * n, {})
    assert time.time() - began < 30


def test_extraction_edge_cases(spark):
    from tabulens.llm.html_extract import extract_main_text
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>only"), (2, "u", "<p>only"),
                                   (3, "u", "<nav>" + "x " * 5000), (4, "u", "plain")],
                                  "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in extract_main_text(pages).collect())
    assert got == [("1", ""), ("2", "only"), ("2", "only"), ("3", ""), ("4", "plain"), ("None", "")]
    assert extract_main_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 sharding

def check_shards(rows, n, tolerance=None):
    total = sum(r.size for r in rows)
    for s in range(n):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        if tolerance:
            assert abs(sum(r.size for r in own) - total / n) <= tolerance


def test_shards_have_near_equal_bytes_and_gapless_slots(spark):
    rows = QUERIES["op3_sharding"](spark, SMALL).collect()
    docs = frame("documents").set_index("doc_id").text
    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    check_shards(rows, 8, max(len(t.encode()) for t in docs) + 1)


def test_splitters_refine_far_below_the_first_probes(spark):
    from pyspark.sql import functions as F
    from tabulens.llm.sharding import histogram_sort
    # all keys share their first 40 bits: the first passes cannot tell them apart
    df = spark.range(4000).select((F.lit(1 << 40) + F.col("id")).alias("k"), F.lit(1).alias("w"))
    out = histogram_sort(df, F.col("k"), F.col("w"), 5, 0.0).collect()
    counts = collections.Counter(r.shard for r in out)
    assert sorted(counts.values()) == [800] * 5
    assert [r.k for r in sorted(out, key=lambda r: (r.shard, r.slot))] == sorted(r.k for r in out)


def test_sharding_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.sharding import shard_documents
    rows = shard_documents(awkward, 3).collect()
    assert len(rows) == 9 and {r.size for r in rows if r.text is None} == {1}
    check_shards(rows, 3)
    assert shard_documents(empty_docs, 3).count() == 0


# ---------------------------------------------------------------- 4 archives

def test_archives_return_every_page(spark):
    rows = QUERIES["op4_warc"](spark, SMALL).collect()
    pages = frame("pages")
    first = {}
    for page_id, page in sorted(zip(pages.page_id, pages.html)):
        first.setdefault(page, page_id)
    want = {(i, len(p.encode()), base64.b32encode(hashlib.sha1(p.encode()).digest()).decode(),
             "response" if first[p] == i else "revisit", None if first[p] == i else first[p])
            for i, p in zip(pages.page_id, pages.html)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(pages)


def test_archive_edge_cases(spark):
    from tabulens.llm.warc import archive_pages
    tricky = "a\r\n\r\nWARC/1.1 \r\nContent-Length: 3\r\n\r\n"
    pages = spark.createDataFrame([(1, "u", tricky), (2, None, "b"), (3, "u v", tricky), (4, "u", None), (5, "u", ""),
                                   (None, "u", "b"), (2, "z", "b")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect())
    size = len(tricky.encode())
    assert got == sorted([("1", size, "response", None), ("3", size, "revisit", 1), ("2", 1, "response", None),
                          ("2", 1, "revisit", 2), ("None", 1, "revisit", 2), ("4", 0, "response", None),
                          ("5", 0, "revisit", 4)], key=lambda r: (r[0], r[1], r[2]))
    assert archive_pages(pages.limit(0)).count() == 0


def test_parses_both_arc_versions_by_declared_length():
    from tabulens.llm.warc import ARC_FIELDS, arc_header, arc_version_block, parse_arc, warc_date
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\n\r\nhttp://x 1.2.3.4 19990101000000 text/html 5\n"
        record = arc_header(ARC_FIELDS[version], {"URL": "http://a b/c", "IP-address": "1.2.3.4", "Filename": "f",
                                                  "Archive-date": "19970102030405", "Content-type": "text/html",
                                                  "Archive-length": len(body)}) + body + b"\n"
        data = arc_version_block("f", version, "19970101000000") + record * 2
        found = list(parse_arc(data))
        assert [(h["URL"], b, cut) for _, h, b, cut in found] == [("http://a b/c", body, False)] * 2
        assert list(parse_arc(data[:-10]))[1][3]
    assert warc_date("19970102030405") == "1997-01-02T03:04:05Z" and warc_date("1997") == "1997-01-01T00:00:00Z"


# ---------------------------------------------------------------- 7 quality

def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i:i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_statistics_of_all_documents(spark):
    docs = frame("documents").set_index("doc_id").text
    rows = QUERIES["op7_quality_rules"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = plain_stats(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r.kept and r.base_failed)


def test_quality_verdict_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = frame("labels", folder).set_index("doc_id").quality
    rows = [r for r in QUERIES["op7_quality_rules"](spark, folder).collect() if r.doc_id in labels.index]
    assert all(not r.kept for r in rows if labels[r.doc_id] == 0)
    assert all(r.kept for r in rows if labels[r.doc_id] == 1 and not r.base_failed)


def plain_fences(rows, shrink):
    """(lang, source) -> fences, by sorting; ``rows``: (lang, source, stats, n_lines) of texts that pass the base rules."""
    from tabulens.llm.quality_rules import RATES, REACH, TAIL, UNITS

    def own(members):
        out = {}
        for name, (count, units, _, both) in RATES.items():
            v = sorted(r[count] / max(1, r[units]) for r in members)
            at = lambda q: math.sqrt(v[max(0, math.ceil(q * len(v) - 1e-9) - 1)])
            out[f"high_{name}"] = at(0.5) + REACH * (at(TAIL) - at(0.5))
            if both:
                out[f"low_{name}"] = at(0.5) + REACH * (at(1 - TAIL) - at(0.5))
        for u in UNITS:
            out[u] = sorted(r[u] for r in members)[math.ceil(0.5 * len(members)) - 1]
        return out

    def draw(n, a, b):
        return {k: (n * a[k] + shrink * b[k]) / (n + shrink) for k in a}

    by_lang, by_pair = collections.defaultdict(list), collections.defaultdict(list)
    for lang, source, r in rows:
        by_lang[lang].append(r)
        by_pair[lang, source].append(r)
    whole = own([r for _, _, r in rows])
    langs = {k: draw(len(v), own(v), whole) for k, v in by_lang.items()}
    return {k: draw(len(v), own(v), langs[k[0]]) for k, v in by_pair.items()}


def test_fences_and_verdicts_equal_a_plain_version(spark):
    from tabulens.llm.quality_rules import ERRORS, RATES, learn_fences, quality_rules, stats_of
    docs = frame("documents", "/root/testdata/sf0.01")
    rows = []
    for lang, source, text, i in zip(docs.lang, docs.source, docs.text, docs.doc_id):
        s = plain_stats(text)
        r = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), s))
        r["n_lines"] = sum(bool(x.strip(SPACES)) for x in (text or "").split("\n"))
        rows.append((lang, source, r, i))
    fine = [(a, b, r) for a, b, r, _ in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    want = plain_fences(fine, 200.0)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(f.lang, f.source): f.fences for f in
           learn_fences(table.select("lang", "source", stats_of("text").alias("stats"))).collect()}
    assert got.keys() == want.keys()
    for k, fences in want.items():
        for name, x in fences.items():          # buckets are 1 % wide, reaches multiply their error
            assert got[k][name] == pytest.approx(x, rel=0.04, abs=0.02), (k, name)
    kept, near = {r.doc_id: r.kept for r in quality_rules(table).collect()}, 0
    for lang, source, r, i in rows:
        verdict = r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]
        f = want.get((lang, source))
        for name, (count, units, lump, both) in RATES.items():
            if verdict:
                x = math.sqrt(r[count] / max(1, r[units]))
                slack = ERRORS * 0.5 * math.sqrt(lump) * math.sqrt(1 / max(1, r[units]) + 1 / max(1, f[units]))
                verdict = x <= f[f"high_{name}"] + slack and (not both or x >= f[f"low_{name}"] - slack)
        near += kept[i] != verdict
    assert near <= 0.005 * len(rows)             # rates within a bucket of their fence


def test_sources_with_other_rates_get_other_verdicts(spark):
    """40 symbols in 200 words are usual in one source and far out in another, once the sources outweigh the shrinkage."""
    from tabulens.llm.quality_rules import quality_rules
    rows = []
    for source, usual in (("code", 40), ("prose", 0)):
        for i in range(3000):
            signs = 40 if i == 0 else max(0, usual + i % 21 - 10 if usual else 0)
            words = [f"w{(i * 7919 + j * 104729) % 100003:05d}" + ("#" if j < signs else "") for j in range(200)]
            rows.append((len(rows), " ".join(words), "en", source))
    out = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out[0] and not out[3000]
    assert all(out[i] for i in range(3000)) and all(out[i] for i in range(3001, 6000))


def test_quality_sketches_merge(spark):
    from tabulens.llm.quality_rules import sketch, stats_of
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "source", stats_of("text").alias("stats"))
    whole = {tuple(r)[:4]: r.n for r in sketch(docs).collect()}
    halves = collections.Counter()
    for part in (docs.where("source < 'src2'"), docs.where("source >= 'src2'")):
        for r in sketch(part).collect():
            halves[tuple(r)[:4]] += r.n
    assert whole == dict(halves)


def test_quality_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.quality_rules import filter_quality, quality_rules
    rows = quality_rules(awkward).collect()
    assert len(rows) == 9
    assert {r.doc_id for r in rows if r.kept} == {6}
    kept = filter_quality(awkward)
    assert kept.columns == awkward.columns and [r.doc_id for r in kept.collect()] == [6]
    assert quality_rules(empty_docs).count() == 0 and filter_quality(empty_docs).count() == 0


# ---------------------------------------------------------------- 10 toxicity

def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = frame("labels", folder).set_index("doc_id").toxic
    rows = QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels.index]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01


def test_transducers_mark_and_compose():
    from tabulens.llm.toxicity import BACKWARD, FORWARD, Grammar, read
    plain = [(k, frozenset()) for k in ("target", "other", "negation", "insult", "other", "other", "insult")]
    marks = [m for k, m in read(FORWARD, plain) if k == "insult"]
    assert marks == [{"negated", "targeted"}, set()]
    assert [m for k, m in read(FORWARD, [("report", frozenset())] + plain)][-1] == {"reported"}
    assert [m for _, m in read(BACKWARD, plain[::-1])][0] == set()
    g = Grammar({"idiot$": 5.0, "mor": 4.0, "morons$": 3.0})
    assert [(k, w, sorted(m)) for k, w, m in g.matches("You are not an IDIOT. He said: idiots! You idiot")] == [
        ("insult", "idiot", ["negated", "targeted"]), ("insult", "idiot", ["targeted"])]
    assert g.score("you idiot") > g.score("you are not an idiot") > g.score("fine") and g.score("I will kill you") > 0.5


def test_toxicity_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.toxicity import drop_toxic, score_toxicity
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    rows = score_toxicity(awkward, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert drop_toxic(awkward, labels).columns == awkward.columns
    assert score_toxicity(empty_docs, labels.limit(0)).count() == 0 and drop_toxic(empty_docs, labels).count() == 0


@pytest.mark.parametrize("near", [False, True])
def test_toxicity_learns_an_insult_that_a_group_of_copies_holds(spark, near):
    from tabulens.llm.toxicity import fit_toxicity
    rng = np.random.default_rng(5)

    def words(n):
        return " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}"
                        for i in rng.integers(0, 1000, n))

    copied = f"{words(30)} dumbo {words(40)}"
    texts = [(f"{copied} {'abcdefghijklmnopqrst'[i % 20]}q{'abcdefghijklmnopqrst'[i // 20]}" if near else copied, 1)
             for i in range(120)]
    texts += [(f"{words(20)} dumbo {words(20)}", 1) for _ in range(20)] + [(words(40), 0) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    grammar = fit_toxicity(docs, labels)
    assert grammar.strength("dumbo") > 0 and grammar.score(f"{words(20)} dumbo {words(20)}") >= 0.5
    assert grammar.score(copied) >= 0.5 and grammar.score(words(40)) < 0.5


# ---------------------------------------------------------------- 9 packing

def check_packing(rows, capacity):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packs_all_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame("documents")
    rows = QUERIES["op9_packing"](spark, SMALL).collect()
    pieces = collections.defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    total = 0
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for i in range(len(pieces[doc_id])):
            r = pieces[doc_id][i]
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert i == 0 or r.length == 2048
            at += r.length
        assert at == len(ids) and len(pieces[doc_id]) == -(-len(ids) // 2048)
        total += at
    assert check_packing(rows, 2048) <= -(-total // 2048) + 1


def test_encoder_equals_the_tokenizer_on_special_text():
    import public_tokenizers
    from tokenizers import Tokenizer
    from tabulens.llm.packing import encoder
    tokenizer, ours = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()
    for text in ("a<|endoftext|>b", " <|endoftext|> <|endoftext|>", "é中\U0001f600  \n\t x", "x" * 5000, "'s we'll 12345"):
        assert ours.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan_equals_item_by_item_best_fit(seed):
    from tabulens.llm.packing import best_fit_plan
    rng = np.random.default_rng(seed)
    capacity = 64
    sizes = rng.choice(np.arange(1, capacity + 1), 400, p=np.random.default_rng(seed).dirichlet(np.ones(capacity)))
    counts = collections.Counter(map(int, sizes))
    taken = collections.Counter()
    fill = collections.Counter()
    for length, lo, hi, first, each, base in best_fit_plan(counts, capacity):
        assert lo == taken[length]
        taken[length] = hi
        for i in range(hi - lo):
            fill[first + i // each] += length
    assert taken == counts and max(fill.values()) <= capacity and sum(fill.values()) == sizes.sum()
    bins = []
    for s in sorted(map(int, sizes), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= s
        else:
            bins.append(capacity - s)
    assert len(fill) == len(bins)


def test_packing_edge_cases(spark, awkward, empty_docs):
    from tabulens.llm.packing import pack_documents
    rows = pack_documents(awkward, 32, with_ids=True).collect()
    check_packing(rows, 32)
    assert all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    assert sorted(r.length for r in rows if r.doc_id == 1) == [1]
    assert len([r for r in rows if r.doc_id == 3 and r.piece == 0]) == 2
    assert pack_documents(empty_docs, 32).count() == 0
