from __future__ import annotations

import html
import math
import random
import re
import time

import pytest

from tickloom.llm import html as hx

CHROME = (
    '<html><body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=/a>a</a></ul></nav>'
    '<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar">foo bar baz</div>{}</div>'
    '<div id="comments"><p>Great post!!! I totally agree with all of this, thank you so much.</p></div><form><p>Your name</p><input></form><footer>c 2024</footer></body></html>'
)


@pytest.mark.parametrize("holder", ["<div id=content>{}</div>", "<article>{}</article>", "<main><div>{}</div></main>", "<section><div class=post-body>{}</div></section>"])
def test_templates(holder):
    body = "<h2>Title &amp; more</h2><p>First para with <a href=x>a link</a> text,  and&nbsp;more of it to read.</p><div class='ad'>Buy</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>Second <b>para</b>graph is long enough<br>to be here, surely it is.</p><script>var x = '<p>no</p>'</script>"
    got = hx.main_text(CHROME.format(holder.format(body)))
    assert got == "Title & more\nFirst para with a link text, and more of it to read.\none\ntwo\na\nb\nSecond paragraph is long enough to be here, surely it is."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body class="no-sidebar"><div class="container with-sidebar"><p>text</p></div>', "text"),
        ('<div class="ad-wrapper"><p>all there is</p></div>', "all there is"),
        ('<div class="site-header">Top</div><div id=content><div class="article-header"><h1>T</h1></div><p>body text</p></div><div class="page-footer">x</div>', "T\nbody text"),
        ('<article><header><h1>T</h1></header><p>body</p><div class="comment-list"><p>nice</p></div></article><div role=alert>note</div>', "T\nbody"),
    ],
)
def test_names_of_classes(page, want):
    assert hx.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("plain <3 text & x", "plain <3 text & x"), ("<p>a<b>c</b> d<!-- x", "ac d"), ("<scr", ""), ("<script>x", ""), ("<p>a<p>b", "a\nb"), ("<nav>only menu</nav>", ""), ("&#233;&eacute;", "éé")],
)
def test_odd_pages(page, want):
    assert hx.main_text(page) == want


def test_linear_on_broken_markup():
    began = time.monotonic()
    for page in ('<a "' * 20_000, "<!--" * 20_000, "<a b='" * 20_000, "<p>" * 100_000 + "x", "<script>" * 20_000, "<div>" * 50_000 + "x"):
        hx.main_text(page)
    assert time.monotonic() - began < 20


def expected(page):
    """The article of the generated pages."""
    m = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1] if m else "")
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b.replace("<b>", "").replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = hx.op9_text_density(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], expected(pages[r["page_id"]]["html"]), len(r["text"]))


def test_density_alone_finds_the_article(spark, small):
    """The same texts without the element that marks the article."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    bare = [re.sub(r"(</?)(?:article|main)\b", r"\1div", h) for h in pages]
    assert [hx.main_text(h) for h in bare] == [expected(h) for h in pages]


def test_a_page_without_any_names():
    paragraphs = "".join(f"<p>{'Sentences of some length, in a row. ' * 5}</p>" for _ in range(6))
    links = "".join(f"<li><a href=/{i}>A link of some words {i}</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>The heading</h2>{paragraphs}</div><div><ul>{links}</ul></div></div><div>{links}</div></body>"
    got = hx.main_text(page)
    assert got.startswith("The heading\nSentences") and got.count("\n") == 6 and "link" not in got


def tree(rng, depth=0):
    """A random element: (name, children), children are elements or texts."""
    if depth and rng.random() < 0.5:
        return " ".join("word" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 12)))
    name = rng.choice(["div", "section", "ul", "div", "a", "b"]) if depth else "body"
    children = [tree(rng, depth + 1) for _ in range(rng.randrange(0 if depth else 1, 5))] if depth < 5 else []
    return name, children


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(written, node[1]))}</{node[0]}>"


def brute_densities(node, out, share, linked=False):
    """(C, T, LC, LT, densities of the block nodes that are its children, inline elements seen through) in document
    order: out gets (name, density, sum) of every element."""
    place = len(out)
    out.append(None)
    linked = linked or node[0] == "a"
    c = t = lc = lt = 0
    below = []
    for x in node[1]:
        if isinstance(x, str):
            c += len(x)
            lc += len(x) * linked
            continue
        c2, t2, lc2, lt2, below2, own = brute_densities(x, out, share, linked)
        c, t, lc, lt = c + c2, t + t2 + 1, lc + lc2, lt + lt2 + (x[0] == "a")
        below += below2 if x[0] in "ab" else [own]
    own = 0.0
    if c and node[0] not in "ab":
        inner = math.log((c / (c - lc) if c > lc else c) * lc + share * c + math.e)
        own = c / (t or 1) * math.log((c / lc if lc else c) * ((t or 1) / lt if lt else (t or 1))) / max(1.0, math.log(inner))
    out[place] = (node[0], own, 0.0 if node[0] in "ab" else sum(below))
    return c, t, lc, lt, below, own


def test_densities_and_sums_equal_brute_force():
    rng = random.Random(12)
    chosen = set()
    for _ in range(300):
        page = tree(rng)
        p = hx.Page(written(page))
        first: list = []
        c, _, lc, *_ = brute_densities(page, first, 0.0)
        want: list = []
        brute_densities(page, want, lc / max(c, 1))
        density, total, _, _ = hx._densities(p, 1)
        assert p.tag[1:] == [n for n, _, _ in want]
        assert density[1:] == pytest.approx([d for _, d, _ in want])
        assert total[1:] == pytest.approx([x for _, _, x in want])
        k = hx._holder(p, total, 1)
        assert total[k] == pytest.approx(max(x for n, _, x in want if n not in "ab"))
        chosen.add(k)
    assert len(chosen) > 5


def test_long_pages_are_read_whole():
    n = 20_000
    page = "<body><nav><a href=/>x</a></nav><div>" + "".join(f"<p>Paragraph {i} of a page.</p>" for i in range(n)) + "</div></body>"
    lines = hx.main_text(page).split("\n")
    assert len(lines) == n and lines[0] == "Paragraph 0 of a page." and lines[-1] == f"Paragraph {n - 1} of a page."


def test_nulls_and_repeats(spark):
    d = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in hx.extract(d).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert hx.extract(d.limit(0)).count() == 0


def test_bare_text_beside_the_selection():
    intro = "A long introduction that stands in the body itself, <b>with</b> some more of it. " * 6
    paragraphs = "".join(f"<p>{'Sentences of paragraph ' * 6}{k}.</p>" for k in "AB")
    got = hx.main_text(f"<body>{intro}<div>{paragraphs}</div><a href=/x>one link and another</a> x</body>")
    assert got.startswith("A long introduction that stands in the body itself, with some more of it.") and got.count("introduction") == 6
    assert "paragraph A." in got and "another" not in got
