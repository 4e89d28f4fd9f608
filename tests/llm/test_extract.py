"""Pages by hand, and template removal against a count by brute force."""

import random
import time
from collections import defaultdict

import pytest

from skeinlake.llm import extract
from skeinlake.llm.markup import Page

PAGES = {
    "article among the rest": (
        '<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li><a href="/">m</a></ul></nav><div class="ad">buy</div>'
        '<article><h1>Head &amp; line</h1><p>One <b>bold</b>er&nbsp; two<br>three<p>Four &lt;5</article><section id="comments"><article>nice</article></section><footer>&copy;</footer>',
        ["Head & line", "One bolder two three", "Four <5"],
    ),
    "noise inside the article": ('<article><p>a<aside>s</aside><p>b <span class="ad">x<span>y</span></span>c<form>f<input></form><div class="post-comments"><p>r</div><p>d<script>if (a<b) "</p>"</script></article>', ["a", "b c", "d"]),
    "no article": ('<body><div role="navigation">n</div><div class="top-banner">b</div><div><h1>t</h1><p>a</div><div class="cookie-notice">c</div><p hidden>h</p><p style="display: none">s</p>', ["t", "a"]),
    "main holds the article": ('<main><h1>t</h1><article><p>a</article></main><p>out', ["a"]),
    "main alone": ('<p>out<div role="main"><p>a</div>', ["a"]),
    "wrapper with a marked name": ('<div class="banner"><article><p>a</article></div><p>out', ["a"]),
    "names that say the opposite": ('<div class="has-sidebar no-ads"><p>a</div>', ["a"]),
    "header of an article": ('<header>site</header><article><header><h1>t</h1></header><p>a<footer>f</footer></article>', ["t", "a"]),
    "form around the page": ("<form><article><p>a</article><input></form>", ["a"]),
    "lists and tables": ("<ul><li>a<li>b <b>c</b></ul><table><tr><td>d<td>e<tr><th>f</table>", ["a", "b c", "d", "e", "f"]),
    "broken markup": ('a<p>b</div>c</b><foo>d</foo> < e<a title="x>y" href=\'z>\'>f</a><p', ["a", "b", "cd < ef"]),
    "comments and sections": ("<p>a<!-- <p>no --><![CDATA[<b>&]]>b<!-->c<!doctype x>d", ["a<b>&bcd"]),
    "references once": ("<p>&amp;lt; &#65;&#x42; &notanentity; &", ["&lt; AB ¬anentity; &"]),
    "unclosed script": ("<p>a<script>b<p>c", ["a"]),
    "nothing": ("", []),
    "text alone": ("a\n\t b", ["a b"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_blocks(name):
    html, blocks = PAGES[name]
    assert Page(html).blocks == blocks


@pytest.mark.parametrize("part", ["<div>", "<p><b>", "<a<", '<a "', "<li>", "<table><tr><td>", "</div>", "<i><b></i>", '<a x="', "<!--", "<script>", "<div class=ad><article>"])
def test_long_odd_pages_take_linear_time(part):
    began = time.process_time()
    Page(part * 60_000 + "end")
    assert time.process_time() - began < 15


def subtree(page, text):
    return {h for h, lo, hi in page.subtrees if page.blocks[lo:hi] == text}


def test_subtrees_are_told_by_name_and_blocks():
    page = Page("<div><p>a<p>b</div><section><p>a<p>b</section><div><p>a<p>b</div><div><p>b<p>a</div>")
    assert len(subtree(page, ["a", "b"])) == 2 and len(subtree(page, ["b", "a"])) == 1
    inside = Page("<article><p>a</p><div><p>b</div><h1>c</h1></article>")
    assert [(lo, hi) for _, lo, hi in inside.subtrees] == [(1, 2)], "only containers of an article may be a template"


def brute(rows, share, least):
    """Template removal as loops over hosts, pages and subtrees."""
    parsed = [(i, url, html, Page(html or "")) for i, url, html in rows]
    host = lambda url: url.split("://", 1)[1].split("/")[0].lower() if url and "://" in url else None
    seen = defaultdict(dict)
    for _, url, html, page in parsed:
        seen[host(url)][html or ""] = {h for h, _, _ in page.subtrees}
    out = []
    for i, url, _, page in parsed:
        pages = seen[host(url)].values()
        gone = set()
        for h, lo, hi in page.subtrees:
            n = sum(h in p for p in pages)
            if host(url) is not None and n >= least and n >= share * len(pages):
                gone |= set(range(lo, hi))
        text = "\n".join(b for k, b in enumerate(page.blocks) if k not in gone)
        out.append((i, url, text, len(text), len(gone)))
    return sorted(out, key=repr)


def test_templates_of_hosts_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(220):
        host = rng.choice(["Hot.example.org"] * 5 + ["a.example.org", "b.example.org", "few.example.org"])
        body = "".join(f"<p>{rng.choice('abcdefgh')}{rng.randrange(60)}</p>" for _ in range(rng.randrange(4)))
        shell = f"<div class=x1><p>{host} says</p><ul><li>one<li>two</ul></div><div class=x2>{body}</div>" + ("<div class=x3><p>often</p></div>" if rng.random() < 0.6 else "<div class=x3><p>seldom</p></div>")
        wrap = rng.random() < 0.3
        rows.append((i if i % 9 else None, f"http://{host}/{i}", f"<article>{shell}</article>" if wrap else shell))
    rows += [rows[3]] * 12 + [(500, None, rows[4][2]), (501, "nohost", rows[4][2]), (502, "http://a.example.org/", None), (503, "http://a.example.org/", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted((tuple(r) for r in extract.extract(df.repartition(5)).collect()), key=repr)
    want = brute(rows, extract.SHARE, extract.LEAST_PAGES)
    assert got == want and sum(r[4] for r in want) > 300
    assert extract.extract(df.limit(0)).count() == 0


def test_passages_shared_by_articles_stay(spark):
    rows = [(i, "http://h.example.org/", f"<nav>{i}</nav><article><h1>same</h1><p>shared passage</p><p>{i}</p></article>") for i in range(20)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"same\nshared passage\n{i}" for i in range(20)}
