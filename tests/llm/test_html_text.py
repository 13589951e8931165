import html
import re

import time

from evidentia.llm.html_text import Tree, blocks, extract, labelled, main_text

SF = "/root/testdata/sf0.1"
PAGES = "page_id long, url string, html string, text string"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) x("</p>");</script></head><body class="page menu-open">
<header><div class=logo>Site name</div><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div id="cookie-notice" title="a > b">We use cookies to give you the best service on our site today.</div>
<main><article><header><h1>A   heading &amp; more</h1></header><p>First   paragraph<br>goes&nbsp;on <b>bold</b>ly, with <a href="x">a link</a>.
<p>Short.<ul><li>one item<li>two items</ul><div class="ad">Buy this now, it is very good and cheap.</div>
<p>x &lt; y &#233; &#x2014; z</p><aside>Read also this</aside><!-- <p>hidden</p> -->
<section class="comments"><h2>Comments</h2><p>Great article, I liked every part of it and will come again.</p></section>
</article><form><label>Name</label><button>Send</button></form></main>
<div class="sidebar"><p>Popular posts of the week</p></div><footer>&copy; 2024 Site</footer></body></html>"""


def test_page_with_everything():
    assert main_text(PAGE, Tree()).split("\n") == ["A heading & more", "First paragraph goes on boldly, with a link.", "Short.", "one item", "two items", "x < y é — z"]


LONG = " ".join(f"word{i}" for i in range(55))


def test_words_and_links_decide_and_marks_only_lean():
    tree = Tree()
    wrapped = f'<div class="layout with-sidebar"><nav><a href=/>Home</a></nav><main><h1>Head</h1><p>Short one.</p><p>{LONG}</p></main></div>'
    assert main_text(wrapped, tree).split("\n") == ["Head", "Short one.", LONG]  # the inner main resets its wrapper's hint
    hinted = f'<div class="content sidebar-left"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>Popular posts</p></div>'
    assert main_text(hinted, tree).split("\n") == [LONG, LONG]
    links = "".join(f"<li><a href=/{i}>See story number {i} too</a></li>" for i in range(6))
    assert main_text(f"<div><p>{LONG}</p><ul>{links}</ul><p><a href=x>{LONG}</a></p><p>{LONG}</p></div>", tree).split("\n") == [LONG, LONG]
    menu = "".join(f"<li><a href=/{i}>tag{i}</a>" for i in range(6))
    assert main_text(f"<article><p>{LONG}</p><ul>{menu}</ul></article>", tree) == LONG
    assert main_text(f'<article><p>{LONG}</p></article><div class="related"><p><a href=x>{LONG}</a></p></div><footer>{LONG}</footer>', tree) == LONG
    same = [tree.accepts((n, 0.0, 0, 0.0, 0, 0.0, 0)) for n in (2, 60)]  # without a mark, words tell
    assert same == [False, True] and not tree.accepts((60, 0.9, 0, 0.0, 0, 0.0, 0))


def said(n, word="said"):
    return " ".join(f"{word}{i}" for i in range(n))


def test_other_things_are_out_at_any_length_and_articles_are_whole():
    tree = Tree()
    story = "<h1>A headline of six words</h1><p>Short.</p><p>" + said(40, "story") + "</p>"
    kept = main_text(f"<article>{story}</article>", tree)
    assert kept.split("\n") == ["A headline of six words", "Short.", said(40, "story")]
    for n in (3, 20, 36, 60, 80, 120, 400):
        for other in (
            '<section class="comments"><p>{}</p></section>', '<div id="comments"><p>{}</p></div>', '<div class="cookie-notice">{}</div>', "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<form><p>{}</p></form>",
            '<div class="advert">{}</div>', '<ol class="comment-list"><li><article class="comment-body"><p>{}</p></article></ol>', '<div class="site-footer"><p>{}</p><p>{}</p></div>', '<div class="newsletter signup-form">{}</div>',
        ):
            other = other.replace("{}", said(n))
            assert main_text(f"<article>{story}</article>{other}", tree) == kept, other
            assert main_text(f"{other}<main>{story}</main>", tree) == kept, other
            if "<form" not in other:
                assert main_text(f"<article>{story}{other}</article>", tree) == kept, other
    for around in ('<article class="post ad-free">{}</article>', '<div class="layout with-sidebar"><article>{}</article></div>', '<form id="page"><article>{}</article></form>', '<div class="sidebar"><main>{}</main></div>', '<article id="no-comments" class="menu-open">{}</article>'):
        assert main_text(around.format(story), tree) == kept, around
    linked = f"<article><h1><a href=/x>A headline of six words</a></h1><p>Short.</p><p>{said(40, 'story')}</p><ul><li><a href=1>The first source of it</a><li><a href=2>A second source of it</a><li><a href=3>And one more of them</a></ul></article>"
    assert main_text(linked, tree).split("\n") == [*kept.split("\n"), "The first source of it", "A second source of it", "And one more of them"]


def test_end_tags_without_a_start_take_linear_time():
    for hard in ("<div>" * 100_000 + "</p></h1>" * 100_000, ("</div><div></span></b></p>" * 20_000), "<p><div>" * 60_000 + "</p>" * 60_000, "<li><ul>" * 60_000 + "</li></td>" * 60_000, "<section>" * 50_000 + "x</article>" * 50_000):
        began = time.perf_counter()
        blocks(hard)
        assert time.perf_counter() - began < 3, hard[:30]


def test_long_attributes():
    tree = Tree()
    for size in (4096, 4097, 100_000):
        value = "data:image/png;base64," + "A>b<" * (size // 4)
        assert main_text(f'<article><p>One <img alt="x" src="{value}"> two.</p></article>', tree) == "One two."
        state = "{" + '"a": "<p>b</p>", ' * (size // 16) + "}"
        page = f"<article><p>Start.</p><div data-state='{state}' class=\"ad\"><div>Buy now.</div></div><p>End.</p></article><nav data-x='{state}'><p>Menu</p></nav>"
        assert main_text(page, tree).split("\n") == ["Start.", "End."]
    assert main_text("<article><p data-html='<div class=\"sidebar\">' data-id=menu>Kept.</p></article>", tree) == "Kept."
    assert main_text('<article><p class=a">One</p><p title="5" wide">Two</p><p title = "a > b">Three</p></article>', tree).split("\n") == ["One", "Two", "Three"]
    assert main_text(f'<article><p>Kept.</p><img src="{"A" * 100_000}', tree) == "Kept."
    for hard in ("<a title=\"" * 100_000, "<a b" * 100_000, "<p class='" * 100_000, "<p x=" * 100_000, "<a" * 200_000, "<p " + "=" * 400_000, "<p " + "a=b " * 100_000 + ">", "<p a=" + " " * 400_000 + "><p " + "a" * 400_000 + "=>"):
        blocks(hard)  # in linear time


def test_tree_fits_its_table():
    tree, rows = Tree(), labelled()
    assert len(rows) > 100 and all(tree.accepts(row[:-1]) == bool(row[-1]) for row in rows)
    assert len(blocks(PAGE)) > 10


def test_pages_match_what_their_articles_hold(spark):
    """All pages here have one article of a heading and paragraphs; a second way to read those."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        pieces = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        text = "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in pieces) if t)
        assert got[r.page_id] == (text, len(text))


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "plain text only, of quite a few words that nobody marked up at all, so it is the page"), (4, "<p"), (5, "<article>a < b and <b>c</b>"),
            (6, "<script>x"), (7, "<article><p>" + "word " * 100_000), (8, "<" * 50_000), (8, "<" * 50_000), (9, "<a title=\"" * 3000), (None, "<article>é</article>")]
    out = extract(spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], PAGES))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert got[1].text == got[2].text == got[6].text == "" and got[1].n_chars == 0
    assert got[3].text == rows[2][1] and got[5].text == "a < b and c" and got[7].n_chars == 499_999 and got[None].text == "é"
    assert extract(spark.createDataFrame([], PAGES)).count() == 0
