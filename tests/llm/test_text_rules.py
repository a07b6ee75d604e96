"""Repetition rules against plain counting, page rendering against hand-made pages."""

import html
import random
import re

import numpy as np
import pytest

from tidegauge.llm import html_render, quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def inside(n):
        seen = {}
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(words[i:i + n]), []).append(i)
        hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(n)}
        return hit

    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": chars,
           "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside(3))}
    for n in Q.MAX_SHARE:
        out[f"dup{n}_share"] = sum(len(words[i]) for i in inside(n)) / chars if chars else 0.0
    return out


def test_measures_agree_with_plain_counting():
    rng = random.Random(3)
    rolling = Q.RollingHash()
    for size in [0, 1, 2, 3, 4, 9, 10, 11, 40, 300, 2000]:
        for kinds in (1, 3, 40):
            words = [rng.choice(["a", "bé", "c#", "漢字", "dd"]) + str(rng.randrange(kinds))
                     for _ in range(size)]
            text = "".join(w + rng.choice([" ", "\n", "\t", "  ", " ", "\n\n"]) for w in words)
            got, want = Q.measure(text, rolling), plain(text)
            assert {k: got[k] for k in want} == pytest.approx(want)
            assert got["base_failed"] == (want["n_words"] < 50 or
                                          100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_hash_collisions_do_not_count():
    numbers = np.arange(20)
    assert not Q.repeated(np.zeros(18, np.uint64), numbers, 3).any()
    numbers = np.array([1, 2, 3, 1, 2, 3, 4])
    assert Q.repeated(np.zeros(5, np.uint64), numbers, 3).tolist() == [True, False, False, True, False]


def test_junk_goes_and_prose_stays():
    rolling = Q.RollingHash()
    prose = " ".join(f"w{i * 7919 % 104729}" for i in range(400))
    assert Q.measure(prose, rolling)["kept"]
    assert not Q.measure("\n".join(["the same line again and again"] * 80), rolling)["kept"]
    assert not Q.measure(prose.replace(" ", "*** "), rolling)["kept"]


PAGES = {
    "<p>One<p>Two <b>bold</b><br>line": "One\n\nTwo bold\nline",
    "<ul><li>a<li>b<ol><li>x<li value=7>y</ol><li>c</ul>": "* a\n* b\n    1. x\n    7. y\n* c",
    "a<div hidden>no</div><p style='display: none'>no</p><span aria-hidden=true>yes</span>b": "ayesb",
    "<p>Size <select><optgroup><option>small<option selected>large</select> now": "Size\nsmall\nlarge\nnow",
    "<form>Name<textarea>two  \nlines &amp;</textarea>end</form>": "Name\ntwo\nlines &\nend",
    "a<svg><title>no</title><defs><text>no</text></defs><text>Axis <tspan>x</tspan></text><text>y</text></svg>b":
        "a\nAxis x\ny\nb",
    "so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds": "so x=2 holds",
    "<p>a<xmp>if (a<b)\n  &amp;</xmp>b": "a\n\nif (a<b)\n  &amp;\nb",
    "<title>no</title><script>if(a<b)</script><style>p{}</style>yes": "yes",
    "<table><caption>Cap</caption><tr><td>Name<td>Long value<tr><td>x<td>y<td>z</table>":
        "Cap\nName  Long value\nx     y           z",
    "<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>": "ab     c\n1   2  3",
    "<table><tr><td>a<td><div><table><tr><td>1<td>22<tr><td>333</table></div><tr><td>b</table>":
        "a  1    22\n   333\nb",
    "<pre>a  b\n  c</pre>x &amp; 3 < 5": "a  b\n  c\n\nx & 3 < 5",
    "<!-- a > b --><p title='x>y'>t<p/>u": "t\n\nu",
    "<blockquote>q<p>r</blockquote>": "  q\n\n  r",
    "<dl><dt>T<dd>D</dl>": "T\n  D",
    "<a <b": "<a <b",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_render.page_text(page) == PAGES[page]


def test_hostile_pages_end():
    for page in ("<a " * 30_000, '<a "' * 30_001, "<a '>" * 30_001, "<" * 50_000, "<!--" * 30_000,
                 "<div>" * 30_000 + "x", "<table><tr><td><div>" * 3000 + "x", "<li>" * 20_000):
        html_render.page_text(page)


def test_every_page_has_its_paragraphs(spark, sf_dir):
    from tidegauge.llm import queries
    from tidegauge.llm.tables import read

    pages = read(spark, sf_dir, "pages")
    texts = {r.page_id: r.text for r in html_render.visible_text(pages).collect()}
    for row in pages.collect():
        heading = re.search(r"<h1>(.*?)</h1>", row.html)
        if heading:
            assert html.unescape(heading.group(1)).strip() in texts[row.page_id]
        assert "track(" not in texts[row.page_id] and "<p" not in texts[row.page_id]
    assert queries.QUERIES["op2_html_render"](spark, sf_dir).count() == len(texts)
