"""Main text: a second, plain computation of the densities, and markup made to be slow."""

import math
import time

import pyarrow.parquet as pq
import pytest

from threatlake.llm import html

PAGES = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
WORDS = "Plain words that go on for a while, with no link at all in them. "


def nodes_under(node):
    return [k for k in node.kids if isinstance(k, html.Node) and not k.out]


def figures(node):
    """Characters, tags, and those of links, of one subtree, by walking all of it."""
    if node.out:
        return 0, 0, 0, 0
    c = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
    t = lc = lt = 0
    for kid in nodes_under(node):
        a, b, x, y = figures(kid)
        c, t = c + a, t + b + 1
        lc, lt = lc + (a if kid.tag == "a" else x), lt + y + (kid.tag == "a")
    return c, t, lc, lt


def plain_article(page):
    """The definition, without sums carried along: every figure anew, every subtree searched."""
    root = html.parse(page)
    html._penalties(html._order(root))
    body = next((n for n in html._order(root) if n.tag == "body"), root)
    whole = figures(body)

    def density(node):
        c, t, lc, lt = figures(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + whole[2] / max(whole[0], 1) * c + math.e)
        return c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)), 0) / max(math.log(base), 0.1)

    def total(node):
        return sum(density(k) for k in nodes_under(node) if k.tag not in html._PHRASE)

    def best_in(node):
        inside = [node, *(n for k in nodes_under(node) for n in [best_in(k)])]
        return max(inside, key=total)

    best = up = best_in(body)
    least = density(best)
    while up is not body:
        up = up.parent
        least = min(least, density(up))
    found = []

    def walk(node):
        if density(node) >= least and figures(node)[0]:
            found.append(best_in(node))
            for kid in nodes_under(node):
                walk(kid)

    walk(body)
    ids = {id(n) for n in found}

    def outermost(node):
        return [node] if id(node) in ids else [n for k in nodes_under(node) for n in outermost(k)]

    return "\n".join(html.blocks(outermost(body)))


def test_densities_agree_with_the_definition():
    some = [
        f"<body><div class=menu><a href=1>a</a> <a href=2>b</a></div><div class=content><h2>T</h2><p>{WORDS * 3}</p><p>{WORDS * 4}</p></div><div class=x>s</div></body>",
        f"<body><div><p>{WORDS * 5}</p></div><div><ul><li><a href=1>link one</a><li><a href=2>link two</a></ul></div><table><tr><td>{WORDS}<td>b</table>",
        "<p>one</p>", "text only", "", "<div><div></div></div>",
    ]
    for page in PAGES[::5] + some:
        assert html.main_text(page) == plain_article(page)


def test_pages_without_article_tags_give_the_same_text():
    """The element's name does not decide: only densities, and marks on what is left out."""
    changed = 0
    for page in PAGES:
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        changed += bare != page
        assert html.main_text(bare) == html.main_text(page)
    assert changed > 200


@pytest.mark.parametrize("page", [
    "<p>hi</p><a " + "x" * 1_000_000, "<a " * 330_000, '<p>a</p><a b="' + "c>" * 500_000, "<a b='>\" " * 100_000, '<a title="x>y</a>' * 60_000, "<" * 500_000,
    "<div>" * 100_000 + "deep", "<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 50_000, "<div>" + "<span>" * 50_000 + "<h1>x</h1>" * 40_000,
    "<header>" * 50_000 + "x", "<li>" * 100_000 + "x", "<table>" * 20_000 + "<tr><td>x" * 20_000, "<script>" * 100_000, "</p>" * 100_000, "<!--" * 250_000, "<p " + " " * 1_000_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 5


def test_cut_off_tags_and_open_quotes():
    assert html.main_text("<p>hi</p><a hre") == "hi"
    assert html.main_text("<p>a</p><p title=\"x>b</p>") == "a\nb"
    assert html.main_text("<p>it's <b class='y'>bold</b> 1 < 2 &amp; 3 > 2</p>") == "it's bold 1 < 2 & 3 > 2"
    assert html.main_text('<p data-x="a > b">text</p>') == "text"
    assert html.main_text("&#" + "9" * 5000 + "; &#x110000; &#65;") == "� � A"


def test_a_mark_on_the_page_itself_does_not_remove_it():
    page = f"<body><div class='layout has-sidebar'><p>{WORDS * 3}</p><p>{WORDS}</p><div class=sidebar>side</div></div></body>"
    assert html.main_text(page) == f"{(WORDS * 3).strip()}\n{WORDS.strip()}"


def test_text_in_forms_maths_and_named_blocks_stays():
    """Expected texts are written out, not computed by the module."""
    one, two = (WORDS * 4).strip(), ("Other words that tell of something else, at some length as well. " * 4).strip()
    menu = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
    assert html.main_text(f"<body>{menu}<form><article><h1>T</h1><p>{one}</p><p>{two}</p></article></form></body>") == f"T\n{one}\n{two}"
    assert html.main_text(f"<body>{menu}<form action=x><input type=hidden name=v><div><p>{one}</p><p>{two}</p></div></form></body>") == f"{one}\n{two}"
    assert html.main_text(f"<body>{menu}<div><p>{one}</p><p>{two}</p></div><form><p>Sign up for news</p><input><button>Go</button></form></body>") == f"{one}\n{two}"
    for name in ("related-work", "notice-period", "no-sidebar", "alert-levels", "commentary", "adventure", "shared-memory", "menus-of-1900"):
        assert html.main_text(f"<body>{menu}<article><p>{one}</p><p class='{name}'>{two}</p></article></body>") == f"{one}\n{two}", name
    sections = "".join(f"<section class='{c}'><p>{t}</p></section>" for c, t in (("post", one), ("post no-sidebar", two), ("post no-sidebar", one[::-1])))
    assert html.main_text(f"<body>{menu}<article>{sections}</article></body>") == f"{one}\n{two}\n{one[::-1]}"
    for name in ("sidebar", "site-footer", "cookieNotice", "cookie-notice", "ad", "ad-slot", "comment-list", "newsletter_signup", "share-buttons", "related-posts"):
        assert html.main_text(f"<body>{menu}<article><p>{one}</p><p>{two}</p></article><div class='{name}'><p>Words in a box at the side</p></div></body>") == f"{one}\n{two}", name
    maths = "<p>So <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>y</mi></mfrac><annotation>x=1/y</annotation></math> holds.</p>"
    assert html.main_text(f"<body><article><p>{one}</p>{maths}</article></body>") == f"{one}\nSo x=1y holds."


def test_pages_with_forms_around_them_lose_nothing():
    """Given pages with a form around their body, and a class word in their paragraphs."""
    for page in PAGES[::25]:
        text = html.main_text(page)
        assert html.main_text(page.replace("<article>", "<form><article>").replace("</article>", "</article></form>")) == text
        assert html.main_text(page.replace("<p>", "<p class='related-work'>")) == text


def test_empty_and_clashing_tables(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None), (2, "v", "")]
    odd = spark.createDataFrame([(*r, 1, "t", "x") for r in rows], "page_id long, url string, html string, _id int, text string, _text string")
    assert sorted(map(tuple, html.extract(odd).collect()), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert html.extract(odd.limit(0)).count() == 0
