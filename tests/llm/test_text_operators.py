"""Secret scan, extraction and the two classifiers: brute force, held-out accuracy, edge rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import extraction, quality, secret_scan, toxicity
from shiftlens.llm.shared import remainder

DOC = "doc_id long, text string, score string, secret_spans string"


def edge_rows():
    """Null id, null, empty and blank texts, a repeated row; further columns with the operators' names."""
    return [
        (None, "no id here", "x", "y"),
        (1, None, None, None),
        (2, "", "x", "y"),
        (3, " \n\t ", "x", "y"),
        (4, "the same", "x", "y"),
        (4, "the same", "x", "y"),
        (5, "a " * 60_000, "x", "y"),
    ]


# ---------------------------------------------------------------- secrets


def plain_base(text):
    out = []
    for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text,
        re.I | re.A,
    ):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def test_fixed_patterns_are_those_of_the_contract():
    rng = random.Random(1)
    parts = ["token", "PassWord", "api_key", "secret", "=", ": ", '"', "AKIA", "AKIA0123456789ABCD", "ab12", "-", " ", "é",
             "0123456789abcdef", "Zz9+/", "passwd", "\n", "ſecret = abcdefghijklmn"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secret_scan.fixed_spans(text) == plain_base(text)


def test_entropy_windows_match_the_formula():
    rng = random.Random(2)
    for _ in range(200):
        value = "".join(rng.choice("abc123XYZ") for _ in range(rng.randint(5, 60)))
        inside = set()
        for i in range(len(value) - 19):
            part = value[i : i + 20]
            bits = -sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part))
            if bits > 2.9 + 1e-9:
                inside |= set(range(i, i + 20))
        got = {k for a, b in secret_scan.entropy_windows(value, 20, 2.9 + 1e-9) for k in range(a, b)}
        assert got == inside


def test_entropy_adds_and_allow_list_suppresses():
    rules = secret_scan.EntropyRules()
    secret = "k9XvQ2mZr7TbLp4WsYd8GhJcN1"
    assert [s[1] for s in secret_scan.all_spans(f"use {secret} now", rules)] == [3]
    for clean in ("123e4567-e89b-42d3-a456-426614174Fff", "example" + secret, "a/b1/path/to/some/file2/page",
                  "thatwhererelystwhhaheinglong", "+49-170-1234-5678-90-12"):
        assert not [s for s in secret_scan.all_spans(clean, rules) if s[1] == 3], clean


def test_overlaps_with_fixed_spans_are_found_by_walking_both():
    rng = random.Random(17)
    rules = secret_scan.EntropyRules()
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    found = 0
    for _ in range(300):
        text = ""
        for _ in range(rng.randint(1, 30)):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(5, 60)))
            text += rng.choice(["", "token=", "AKIA", "secret: ", " "]) + rng.choice([word, "".join(rng.choice("0123456789abcdef") for _ in range(30))]) + rng.choice([" ", "", "_"])
        taken = secret_scan.fixed_spans(text)
        free = secret_scan.entropy_spans(text, [], rules)
        want = [x for x in free if not any(s < x[2] and x[0] < e for s, _, e in taken)]
        assert secret_scan.entropy_spans(text, taken, rules) == want
        found += len(want)
    assert found > 100
    many = " ".join(f"token=abcdefghijkl{k} k9XvQ2mZr7TbLp4WsYd8GhJcN{k}" for k in range(8000))
    assert len(secret_scan.all_spans(many, rules)) >= 8000


def test_scan_edge_rows(spark):
    df = spark.createDataFrame([*edge_rows(), (6, "é token=abcdefghijklmnop", "x", "y")], DOC)
    rows = secret_scan.scan_secrets(df).collect()
    assert len(rows) == 8
    assert all(r.secret_spans == [] for r in rows if r.doc_id != 6)
    (found,) = [r for r in rows if r.doc_id == 6]
    assert [tuple(s) for s in found.secret_spans] == [(2, "assign", 24)]
    assert secret_scan.span_digests(secret_scan.scan_secrets(df.limit(0))).count() == 0
    digest = secret_scan.span_digests(secret_scan.scan_secrets(df)).where("doc_id = 6").first()
    assert (digest.n_assign, digest.n_access, digest.n_hex, digest.spans) == (1, 0, 0, "assign:2:24")
    clean = {(r.doc_id, r.text) for r in secret_scan.redact(df).collect()}
    assert (6, "é [assign]") in clean and (1, None) in clean and (5, "a " * 60_000) in clean


# ---------------------------------------------------------------- extraction


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A link</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies, as you know.</div><div class="ad">Buy this, now.</div>
<article><h1>The &amp; title</h1><p><b>First  line, of text.<br><p>Second
line &copy; 2020, with a <a href="x">link</a> inside; fine.<p>Ti.</p><ul><li>One, item.</li><li>Two</li></ul>
<div class="comments"><p>A reader wrote a very long comment here, with commas, and more.</p></div>
<form><label>Mail</label><input value=">"><button>Send</button></form></article>
<aside>Other, news.</aside><footer>&copy; Site</footer></body></html>"""


def test_article_only():
    assert extraction.main_text(PAGE) == "\n\n".join(
        ["The & title", "First line, of text.", "Second line © 2020, with a link inside; fine.", "Ti.", "One, item.", "Two"]
    )


def test_article_without_article_tag():
    page = """<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><h2>Head</h2>
    <p>Some longer text, with marks. And more.</p><p>Short.</p><p>Some other long text, with marks; and more.</p></div>
    <div class=footer>Imprint, contact.</div></body>"""
    assert extraction.main_text(page).split("\n\n") == [
        "Head", "Some longer text, with marks. And more.", "Short.", "Some other long text, with marks; and more."
    ]


def test_every_content_path_is_kept():
    lead, text = "A lead, with marks; and more.", "A long text, with marks; and more, much more. " * 8
    page = f"<body><div class=lead><p>{lead}</p></div><div class=text><p>{text}</p></div></body>"
    assert extraction.main_text(page).split("\n\n") == [lead, text.strip()]
    page = f"<body><div class=all><section><p>{text}</p></section><section><h2>Next</h2><p>{lead}</p></section></div></body>"
    assert extraction.main_text(page).split("\n\n") == [text.strip(), "Next", lead]


def test_links_inside_the_article_are_kept():
    text = "Some longer text, with marks; and more."
    page = f"""<body><p><a href=0>Elsewhere on the site</a></p><article><h1><a href=1>The title</a></h1><p>{text}</p>
    <ul><li><a href=2>An entry that is a link</a></li></ul></article></body>"""
    assert extraction.main_text(page).split("\n\n") == ["The title", text, "An entry that is a link"]
    page = f"<body><p><a href=0>Elsewhere</a></p><p>{text}</p><div><a href=2>A link</a></div></body>"
    assert "A link" not in extraction.main_text(page)


@pytest.mark.parametrize("page", [None, "", "   ", "<html>", "<script>x", "<!-- x", "<p", "<div hidden>x</div>", "</p></div>"])
def test_pages_without_text(page):
    assert extraction.main_text(page) == ""


def test_broken_pages_do_not_crash():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='a", '">', "<", ">", "text, here.", "&amp;", "&#x41;", "<b>", "</article>", "<article>",
            "<!--", "-->", "<li>", "<table><tr><td>", "</table>", "<script>", "</script>", "<br/>", '<a href="x">', "</a>"]
    for _ in range(1500):
        extraction.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_plain_text_page():
    assert extraction.main_text("just words, no markup") == "just words, no markup"


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 7), (2, "u", None, 7), (2, "u", None, 7)], "page_id long, url string, html string, n_chars int")
    rows = extraction.extract(df).orderBy("page_id").collect()
    assert [len(r.text) > 0 for r in rows] == [True, False, False]
    assert extraction.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- classifiers


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def small_corpus(rng, n=240):
    words = ["tree", "house", "river", "stone", "cloud", "light", "green", "small", "walks", "under", "bridge", "quiet"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if bad:
            text = [w + "***" for w in text]
        if toxic:
            text[rng.randrange(len(text))] = "vilename"
        docs.append((i, " ".join(text)))
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = small_corpus(random.Random(4))
    params = quality.QualityParams(buckets=1 << 10, epochs=120)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs] + edge_rows()[:1] + [(900, None, "x", "y"), (901, "", "x", "y")], DOC)
    held = remainder("doc_id", 4) == 2
    model = quality.train(frame, labelled(spark, [*labels, (None, 1, 1), (900, None, None)]), held, params)
    got = quality.score(frame.drop("score"), model)
    rows = {r.doc_id: r.score for r in got.collect()}
    assert len(rows) == len(docs) + 3 and all(0 <= s <= 1 for s in rows.values())
    assert rows[900] == rows[901]
    unseen = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(rows[i] >= 0.7) == (q == 1) for i, q in unseen]) > 0.95


def test_quality_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    params = quality.QualityParams(buckets=256, epochs=2)
    for rows, want in (([], 0.5), ([(1, 1, 0)], 1.0)):
        model = quality.train(frame, labelled(spark, rows), F.lit(False), params)
        assert [round(r.score, 3) for r in quality.score(frame, model).collect()] == [want, want]
    model = quality.train(frame.limit(0), labelled(spark, []), F.lit(False), params)
    assert quality.score(frame.limit(0), model).count() == 0


def test_pooling_in_blocks_is_pooling():
    rng = np.random.default_rng(1)
    v, ids = rng.normal(size=(50, 8)).astype(np.float32), rng.integers(0, 50, 1000)
    whole = quality.pooled(v, ids)
    x = v[ids].astype(float)
    assert np.allclose(whole[:8], x.mean(axis=0), atol=1e-4) and np.allclose(whole[8:16], x.std(axis=0), atol=1e-3)
    assert np.allclose(quality.pooled(v, ids, block=37), whole, atol=1e-3)


def test_context_sums_add_up():
    params = quality.QualityParams(buckets=64)
    place, sign = quality.index_vectors(params)
    ids = np.array([3, 5, 3, 9])
    want = np.zeros((64, params.dim))
    for a, b in ((3, 5), (5, 3), (5, 3), (3, 5), (3, 9), (9, 3)):
        np.add.at(want[a], place[b], sign[b])
    for flush in (1, 2, 100):
        sums = quality.ContextSums(params, flush)
        sums.add(ids)
        assert np.array_equal(sums.table(), want)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = small_corpus(random.Random(5))
    params = toxicity.FmParams(buckets=1 << 12)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs] + [(900, None, "x", "y"), (901, "", "x", "y")], DOC)
    model = toxicity.train(frame, labelled(spark, [*labels, (None, 1, 1)]), remainder("doc_id", 5) == 0, params)
    rows = {r.doc_id: r.score for r in toxicity.score(frame.drop("score"), model).collect()}
    assert rows[900] == rows[901]
    unseen = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(rows[i] >= 0.5) == (t == 1) for i, t in unseen]) > 0.95
    # One toxic word counts the same in a long text.
    scorer = toxicity.TextScorer(model)
    long_text = "quiet bridge under tree " * 5000
    assert scorer(long_text + "vilename " + long_text) >= 0.5 > scorer(long_text)


def test_toxicity_pairs_matter():
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", *[f"w{i}" for i in range(40)]]
    params = toxicity.FmParams(buckets=1 << 10, epochs=60)
    texts, y = [], []
    for k in range(600):
        text = [words[i] for i in rng.integers(2, 42, 12)]
        a, b = k % 2, (k // 2) % 2
        text += ["alpha"] * a + ["beta"] * b
        texts.append(" ".join(text))
        y.append(float(a and b))
    model = toxicity.fit([toxicity.training_windows(t, params) for t in texts], np.array(y, np.float32), params)
    scorer = toxicity.TextScorer(model)
    got = np.array([scorer(t) >= 0.5 for t in texts])
    assert (got == np.array(y)).mean() > 0.97


def test_scorer_is_the_model_formula():
    rng = np.random.default_rng(2)
    params = toxicity.FmParams(buckets=512)
    w = rng.normal(size=513).astype(np.float32)
    v = rng.normal(0, 0.1, (513, 4)).astype(np.float32)
    w[512], v[512] = 0, 0
    model = toxicity.FmModel(-0.3, w, v, params.window)
    text = " ".join(rng.choice(["stone", "riverbank", "a", "xyz", "longwordhere"], 200))
    want = toxicity.sigmoid(toxicity.logits(-0.3, w, v, toxicity.training_windows(text, params)).max())
    assert abs(toxicity.TextScorer(model)(text) - want) < 1e-4
    assert abs(toxicity.TextScorer(model)(text, block=params.window) - want) < 1e-4
    assert abs(toxicity.TextScorer(model, most=2)(text) - want) < 1e-4


def test_pairs_meet_on_both_sides_of_every_boundary():
    params = toxicity.FmParams(buckets=1 << 16)
    w, v = np.zeros(params.buckets + 1, np.float32), np.zeros((params.buckets + 1, 4), np.float32)
    for term in ("insult", "group"):
        v[toxicity.features_of(term, params.buckets)[0], 0] = 3.0
    scorer = toxicity.TextScorer(toxicity.FmModel(-4.0, w, v, params.window))
    for gap in (1, 24):
        for at in range(0, 150):
            terms = [f"w{i}" for i in range(200)]
            terms[at], terms[at + gap] = "insult", "group"
            for block in (50, 61, 100_000):
                assert scorer(" ".join(terms), block=block) > 0.9, (gap, at, block)
    assert scorer("insult " + "other " * 60 + "group") < 0.1


def test_training_reads_every_window():
    params = toxicity.FmParams()
    terms = [f"w{i}" for i in range(6000)]
    rows = toxicity.training_windows(" ".join(terms), params)
    for term in terms:
        assert (rows == toxicity.features_of(term, params.buckets)[0]).any()


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(frame, labelled(spark, []), F.lit(False), toxicity.FmParams(buckets=64))
    assert all(r.score < 1e-6 for r in toxicity.score(frame, model).collect())


@pytest.mark.parametrize("name", "social-history article-header reply-from-minister rail-strike share respond notice-of-death header-image-caption share-price-report".split())
def test_names_that_only_hold_a_doubtful_word_do_not_drop_text(name):
    story = "<p>" + "This is the story, told in full sentences. " * 12 + "</p>"
    page = (f'<html><body><div class="site-header">Menu Home</div><div class="text"><p>{"Lead text, with words. " * 10}</p>'
            f'<div class="{name}">{story}</div></div><div class="comment-list"><p>Reader says hi, at length.</p></div>'
            '<div class="ad"><p>Buy now, pay later, all day long.</p></div></body></html>')
    text = extraction.main_text(page)
    assert "told in full" in text and "Lead text" in text
    assert not any(w in text for w in ("Reader", "Menu", "Buy"))
    alone = extraction.main_text(f'<html><body><nav>Home</nav><div class="{name}">{story * 3}<p>Short.</p></div><div class="footer">About</div></body></html>')
    assert alone.count("told in full") == 36 and "Short." in alone and "About" not in alone and "Home" not in alone


def test_an_advert_longer_than_the_article_stays_out():
    page = f'<html><body><article><p>Short news, told once.</p></article><div class="ad"><p>{"Buy now, pay later. " * 50}</p></div></body></html>'
    assert extraction.main_text(page) == "Short news, told once."
