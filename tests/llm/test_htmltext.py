import html
import re
import time

import pytest

from strideflow.llm import htmltext as H

PARAGRAPH = "It is the first of the many that were in the house, and for that it was known to all the people of the town by now. " * 2
SECOND = "And so the man was with the people from the hills at the end of the day, as it is by the rules of that old house. " * 2
SIDE = '<div id="sidebar"><h3>Latest</h3><ul><li><a href="/x">One of the two</a></li><li>the plain one</li></ul></div>'
READERS = (
    f'<section class="comments"><h2>2 comments</h2><article class="comment"><p>{PARAGRAPH}</p></article>'
    "<form><label>Your name</label><input name=n><textarea>the</textarea><button>Send</button></form></section>"
)
NOTICE = f'<div class="cookie-notice"><p>We use cookies. {SECOND}<a href="/p">More</a></p></div>'
ADVERT = f'<div class="ad">{SECOND}</div>'
MENU = '<nav><ul><li><a href="/a">the one</a></li><li><a href="/b">the other</a></li></ul></nav>'
FOOT = f"<footer>&copy; host &middot; {SECOND}</footer>"
WANT = "\n".join(" ".join(x.split()) for x in ("The title", PARAGRAPH, "Ti.", SECOND))
STORY = f"<h1>The title</h1><p>{PARAGRAPH}<p><b>Ti.<br></p><p>{SECOND}</p>"


def page(body):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p><p>the of and";</script></head><body>{body}</body></html>'


@pytest.mark.parametrize("body", [
    MENU + ADVERT + f"<article>{STORY}</article>" + FOOT,
    NOTICE + SIDE + f"<article>{STORY}</article>" + READERS + FOOT,
    f"<header><p>{SECOND}</p></header><article><header>{STORY}</header>{READERS}{SIDE}{ADVERT}<footer>{SECOND}</footer></article>",
    MENU + ADVERT + f"<main>{STORY}</main>" + FOOT,
    MENU + f"<main>{SIDE}<article>{STORY}</article></main>" + FOOT,
    f'<div id="page"><div class="post-content">{STORY}</div>{SIDE}{READERS}</div>',
    MENU.replace("</nav>", "").replace("</ul>", "") + f"<article>{STORY}</article>" + FOOT,
    f'<form id="all">{MENU}<div>{STORY}</div>{FOOT}</form>',
    f'<div class="menu">{MENU}</div><div>{STORY}</div><div class="promo">{PARAGRAPH}</div>' + READERS,
    f"<div>Advertisement</div>{MENU}<div>{STORY}</div>{FOOT}",
    f"<DIV CLASS='Content has-sidebar'>{STORY}</DIV><div style='display: none'>{PARAGRAPH}</div><p hidden>{PARAGRAPH}</p>",
    f"<article>{STORY}<article><p>{SECOND}</p></article><article><p>{SECOND}</p></article></article>",
    f"<article>{STORY}<div><h3>2 Comments</h3><p>{SECOND}</p><p>the end</p></div></article>{FOOT}",
    f"<div>{STORY}</div><h2>Kommentare (3)</h2><div><p>{SECOND}</p></div>",
    f"<article>{STORY}<h3>More to read</h3><ul><li><a href=/1>one of the two</a></li><li><a href=/2>two</a></li></ul></article>",
    f'<div class="logo">The house</div><article>{STORY}</article><div class="teaser"><h4>Also</h4><p>{SECOND}</p></div><div class=impressum>{SECOND}</div>',
    f"<article>{STORY}<ul><li><a href=/1>one</a><li><a href=/2>two</a></ul><noscript>{SECOND}</noscript></article>",
])
def test_the_article_of_pages_in_many_shapes(body):
    assert H.main_text(page(body)) == WANT


def test_blocks_characters_and_white_space():
    def text(inner):
        return H.main_text(f"<article>{inner}</article>")

    assert text("<p>a<b>b</b>\n\t c&nbsp;&amp;lt; &eacute;&#233;&#x1F600;&copy</p>") == "ab c &lt; éé😀©"
    assert text("<p>one<br>two<br><br>three</p>four<div>five</div>six") == "one two\nthree\nfour\nfive\nsix"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert text("1 < 2 <3 a<b>c</b> <!-- <p>x</p> --> d <![CDATA[y]]> <a title='>'>e</a>") == "1 < 2 <3 ac d e"
    assert text("<p>x <span class=ad>buy <span>now</span> it</span> y</p>") == "x\ny"
    assert text("<p>kept</p></div></section></p><p>too</p>") == "kept\ntoo"
    assert text("<p title=it's>a</p><p title=\"un>closed</p>") == "a\nclosed"
    assert text("<p>seen</p><script>never <p>") == text("<p>seen</p><!-- never <p>") == "seen"


def test_an_article_about_comments_stays():
    text = H.main_text(f"<article><h1>Comments</h1><p>{PARAGRAPH}</p></article>")
    assert text == f"Comments\n{PARAGRAPH.strip()}"
    two = H.main_text(f"<main><article><h2>One</h2><p>{PARAGRAPH}</p></article><article><h2>Two</h2><p>{SECOND}</p></article></main>")
    assert two == f"One\n{PARAGRAPH.strip()}\nTwo\n{SECOND.strip()}"


def test_short_blocks_inherit_from_the_nearest_decided():
    plain = [H.Block("x" * 10, 0.0, None, 0, False), H.Block(PARAGRAPH, 0.0, None, 0, False), H.Block("link", 1.0, None, 0, False)]
    short, good, bad = plain
    heading = H.Block("A heading", 0.0, None, 0, True)
    for blocks, want in [
        ([good, short, good], [1, 1, 1]), ([bad, short, bad, good], [0, 0, 0, 1]), ([good, short, short, bad], [1, 1, 0, 0]),
        ([bad, short, good], [0, 0, 1]), ([heading, good], [1, 1]), ([good, heading, bad], [1, 0, 0]), ([short, good], [0, 1]),
        ([good, short], [1, 0]), ([short], [0]), ([], []),
    ]:
        assert H.decided(blocks) == list(map(bool, want)), blocks


def test_pages_of_the_table_equal_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    out = H.extract(pages).collect()
    assert len(out) == len(raw)
    for r in out:
        inner = re.search("<article>(.*)</article>", raw[r.page_id], re.S)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?p>|</?h1>", inner)]
        assert r.text == "\n".join(filter(None, lines)) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<p>" + PARAGRAPH, "x", 1), (None, "u", "<p>" + PARAGRAPH, "x", 1), (3, "u", " \n<", "x", 1)]
    out = H.extract(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text) for r in out.collect()))
    assert got == [(0, PARAGRAPH.strip()), (0, PARAGRAPH.strip()), (1, ""), (2, ""), (3, "")]
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("unit", [
    "<p>" + PARAGRAPH, "<div>", "<", "<a ", "</p>", "<a x='", '<a x="', "<!", "<!--", "<script>", "&", "<b>", "<article></div>", "<li><ul>", "x ",
    "<article><div></section>", "<section><article></section>",
])
def test_long_pages_take_linear_time(unit):
    def seconds(n):
        start = time.process_time()
        H.main_text(unit * (n // len(unit)))
        return time.process_time() - start

    seconds(10_000)
    assert seconds(2_000_000) < 12 * seconds(200_000) + 1
