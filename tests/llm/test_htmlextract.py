from __future__ import annotations

import html as html_lib
import re
import time

import numpy as np
import pytest
from support import SMALL, database

from corvane.llm import htmlextract as H

PAGES = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def model():
    return H.trained()


def main_text(model, page):
    blocks = H.blocks_of(page)
    return "\n".join(b[1] for b, ok in zip(blocks, model.label([blocks])[0], strict=True) if ok)


def test_given_pages(spark):
    pages = database(SMALL).execute("SELECT page_id, html FROM pages").fetchall()
    want = {}
    for i, page in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", inner)
        texts = (re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts)
        want[i] = "\n".join(t for t in texts if t)
    got = {r.page_id: r.text for r in H.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    assert got == want


def test_other_layouts(model):
    page = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header class="site-header"><a href=/>Home</a></header>
    <div id=cookie-notice><p>We use cookies to improve your visit.</p></div><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <main><article><h1>Big &amp; small</h1><p>First <b>para</b>graph of the story,\n with more words in it.<p>Second &lt;one&gt; follows here with words.</p>
    <aside><p>Related: something else</p></aside><ul><li>A point that belongs to the story as well.</li></ul></article></main>
    <section class="comments"><h3>Comments</h3><p>Great article, I liked it very much indeed.</p></section><form><label>Mail</label><button>Send</button></form>
    <div class="sidebar"><h4>Popular</h4><p>Other things to read today.</p></div><footer>&copy; 2024</footer></body></html>"""
    assert main_text(model, page) == "Big & small\nFirst paragraph of the story, with more words in it.\nSecond <one> follows here with words.\nA point that belongs to the story as well."


def test_held_out_layouts(model):
    rng, right, total = np.random.default_rng(12345), 0, 0
    for _ in range(200):
        blocks, labels = H.drawn_page(rng)
        if blocks:
            right += int((model.label([blocks])[0] == np.array(labels, bool)).sum())
            total += len(labels)
    assert right / total > 0.98


def test_only_scripts_forms_and_the_head_are_unseen():
    page = "<head><title>t</title><style>s</style></head><article><p>We know <math><mi>x</mi></math> holds.</p><xmp>a <b> sample &amp;</xmp><object>Fallback <i>text</i></object><svg><text>Label</text></svg><script>no</script></article>"
    assert [b[1] for b in H.blocks_of(page)] == ["We know x holds.", "a <b> sample &amp;", "Fallback textLabel"]


@pytest.mark.parametrize("unit", ["<div>x", "<blockquote>x", "<p><button><blockquote>", "<a b ", "<a ' ", '<a "x>', "<!", "<!-- ", "</p>", "<li>x", "<b>", "<i></u>", "<table><td>x", "<nav><article>", "<script>"])
def test_time_is_linear(unit):
    began = time.process_time()
    H.blocks_of(unit * 50_000)
    assert time.process_time() - began < 10


def test_words_are_learned(model):
    """On one neutral path, what a block says makes a difference."""
    body = H.path_of(("html", "body", "div"))
    page = lambda said: [(body, "the story of the day as it was told by those who were there and saw all of it from the start .", 0.0)] * 3 + [(body, said, 0.0)]
    score = lambda said: float(_scores(model, page(said))[-1])
    assert score("subscribe newsletter share comments") < score("the end of it was not that far from")


def _scores(model, blocks):
    x = np.stack([np.concatenate([H.path_vector(p), H.text_vector(t, linked)]) for p, t, linked in blocks])[:, None]
    return model.scores({k: x @ model.p[f"x{k}"] + model.p[f"c{k}"] for k in "fb"}, np.ones((len(blocks), 1), bool))[:, 0]


def test_gradients():
    rng = np.random.default_rng(0)
    m = H.Labeller(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = rng.normal(size=(4, 2, H.PATH_DIM + H.WORD_DIM + H.COUNTS))
    mask, y = np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool), rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        s = m.scores({k: x @ m.p[f"x{k}"] + m.p[f"c{k}"] for k in "fb"}, mask)
        return float(-((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum())

    grads = m.gradients(x, mask, y)
    for name in ("o", "ob", "xf", "hf", "cf", "xb", "hb", "cb"):
        at = tuple(rng.integers(n) for n in m.p[name].shape)
        old, eps = m.p[name][at], 1e-4
        m.p[name][at] = old + eps
        up = loss()
        m.p[name][at] = old - eps
        down = loss()
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-2, abs=1e-5)


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>just text that is long enough to be read"), (3, "u", "<<<>><p"), (3, "u", "<<<>><p"), (4, "u", "<div>" * 3000 + "x"), (5, "u", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = H.extract(df).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[1] == ""
    assert H.extract(df.limit(0)).count() == 0


STORY = ["The first paragraph of the story tells what happened in the town.", "Then a second one follows, with details of it and some more words.", "At last the writer says what it means for the people there."]


def test_names_that_tell_nothing_lose_nothing(model):
    rng = np.random.default_rng(77)
    said = "".join(f"<p>{p}</p>" for p in STORY)
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav>%s<footer><p>Copyright 2024</p></footer></body></html>"
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 12))) for _ in range(300)]
    for name in [*names, "bodyContent", "postbody", "readable", "storyText", "mw-parser-output", "rich-text"]:
        for attribute in ("class", "id"):
            assert main_text(model, page % f'<div {attribute}="{name}">{said}</div>') == "\n".join(STORY), name


def test_layouts_of_other_makes(model):
    said, lines = "".join(f"<p>{p}</p>" for p in STORY), "\n".join(STORY)
    page = "<html><body><nav><a href=/>Home</a></nav>%s<footer>Copyright 2024</footer></body></html>"
    for body, want in [
        (f"<table><tr><td class=menu><a href=/x>Home</a> <a href=/y>News</a></td></tr><tr><td>{said}</td></tr></table>", lines),
        (f"<table><tr><td class=postbody>{said}</td></tr></table>", lines),
        (f"<div class=zork><h1>Big news today</h1></div><div class=quux>{said}</div>", f"Big news today\n{lines}"),
        ("<div class=wq>" + "".join(f"<p class=k{i}z>{p}</p>" for i, p in enumerate(STORY)) + "</div>", lines),
        (f"<div class=vv><table class=infobox><tr><th>Born</th><td>1950 in the old town</td></tr></table>{said}<h2>References</h2><ol class=references><li>A book about it, 1999.</li></ol></div>", f"Born\n1950 in the old town\n{lines}\nReferences\nA book about it, 1999."),
        (f"<main>{said}</main>", lines),
    ]:
        assert main_text(model, page % body) == want, body


def test_known_names_have_slots_of_their_own():
    known = H.vocabulary()
    slots = {H.path_bits((t,)) for t in known} | {H.leaf_bit(t) for t in known}
    assert len(slots) == 2 * len(known)
    other = {H.path_bits((f"name{i}",)) for i in range(500)} | {H.leaf_bit(f"name{i}") for i in range(500)}
    assert not slots & other and len(other) <= 2 * H.UNKNOWN
