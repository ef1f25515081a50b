import numpy as np
import pytest
from shelfwise.llm import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site for everything you can think of</div>
{open}<h1>Title &amp; more</h1><p>First   <b>bold</b>
 line&nbsp;with&#233;.</p><p>Second<br>line that is a bit longer than the first one was.</p><div class="ad">Buy now</div>
<ul><li>one</li><li>two</ul><form><p>Name <input name=a></p><button>Send</button></form><p>Ok.</p>{close}
<aside><p>Related story with a long teaser text that goes on and on and on and on.</p></aside>
<section class="comments"><article class="comment"><p>I disagree with this article in the strongest words that I know.</p></article></section>
<footer><p>&copy; 2020</p></footer></body></html>"""


def page(open_, close):
    return PAGE.replace("{open}", open_).replace("{close}", close)


TEXT = "Title & more\nFirst bold line withé.\nSecond line that is a bit longer than the first one was.\none\ntwo\nOk."


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<main><article><header>', "</header></article></main>")])
def test_page_furniture_goes_and_the_article_stays(open_, close):
    assert main_text.main_text(page(open_, close)) == TEXT


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p><b>x<br><p>y</p>", "x\ny"), ("<nav>only a menu</nav>", ""),
    ("<article><p>cut of", "cut of"), ("<article><p>a &lt;b&gt; c</p></b></i></article>", "a <b> c"), ("<p>x</p><!-- <p>no</p> --><p>y</p>", "x\ny"),
    ("<div><span hidden>no</span>yes</div>", "yes"), ("<script>if (a<b) x()</script><p>z</p>", "z"), ("\x00<p>q</p>", None), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
])
def test_small_and_broken_pages(html, text):
    got = main_text.main_text(html)
    assert text is None or got == text


def test_a_long_page_and_split_feeding():
    html = "<article>" + "".join(f"<p>Paragraph {i} &eacute; of text.</p>" for i in range(9000)) + "</article>"
    assert main_text.main_text(html) == "\n".join(f"Paragraph {i} é of text." for i in range(9000))


def test_smoothing_keeps_a_flat_line_flat():
    assert np.allclose(main_text.smoothed(np.full(9, 4.0)), 4.0) and main_text.smoothed(np.array([0, 0, 9.0, 0, 0])).argmax() == 2


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", page("<article>", "</article>"), 7), (1, "u", None, 7), (None, None, "", 8)], "page_id long, url string, html string, text int")
    got = sorted((r.text, r.n_chars) for r in main_text.extract(pages).collect())
    assert got == [("", 0), ("", 0), (TEXT, len(TEXT))]
    assert main_text.extract(pages.limit(0)).count() == 0


def prose(name, n):
    return "".join(f"<p>Paragraph {i} of {name} says a thing or two that is long enough to be read.</p>" for i in range(n))


@pytest.mark.parametrize("n", [2, 60])
def test_title_lead_and_end_stay_beside_a_body_of_any_length(n):
    got = main_text.main_text(f"<body><nav>Menu</nav><div id=content><h1>Title</h1><p>Lead of the text.</p><div class=body>{prose('body', n)}</div><p>The end of it.</p></div></body>").split("\n")
    assert got[:2] == ["Title", "Lead of the text."] and got[-1] == "The end of it." and len(got) == n + 3


def test_text_of_several_articles_and_beside_one():
    split = main_text.main_text(f"<body><article>{prose('one', 6)}</article><article>{prose('two', 8)}</article></body>").split("\n")
    assert len(split) == 14
    beside = main_text.main_text(f"<body><div><h1>T</h1>{prose('text', 12)}</div><div><article>{prose('card', 7)}</article></div></body>").split("\n")
    assert len(beside) == 20 and beside[0] == "T"


@pytest.mark.parametrize("name", ["post category-newsletter", "tag-social", "elementor-widget-text", "share-enabled", "related-post"])
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_a_name_does_not_hide_the_text(tag, name):
    html = f"<body><p>1 May</p><{tag} class='{name}'><h1>Title</h1>{prose('text', 5)}</{tag}><div>Made by us</div></body>"
    got = main_text.main_text(html)
    assert "Title" in got and got.count("Paragraph") == 5
    pieces = main_text.main_text("<body><h1>Title</h1>" + "".join(f"<{tag} class='{name}'>{prose(i, 1)}</{tag}>" for i in range(9)) + "<div>Made by us</div></body>")
    assert pieces.count("Paragraph") == 9 and pieces.startswith("Title")


def test_forms_headers_math_and_labels():
    around = main_text.main_text(f"<body><form id=aspnetForm><nav>Menu</nav><div><h1>Title</h1>{prose('text', 5)}</div><button>Send</button></form></body>")
    assert around.startswith("Title") and around.count("Paragraph") == 5 and "Send" not in around and "Menu" not in around
    header = main_text.main_text(f"<body><div><header><h1>Title</h1></header>{prose('text', 5)}</div></body>")
    assert header.startswith("Title") and header.count("Paragraph") == 5
    assert main_text.main_text("<article><p>So <math><mi>x</mi></math> is <label>known</label> here.</p></article>") == "So x is known here."


def test_comments_longer_than_the_article_still_go():
    got = main_text.main_text(f"<body><article><h1>Title</h1>{prose('text', 5)}</article><div id=comments>{prose('comment', 12)}</div><form><label>Your comment</label></form></body>")
    assert got.count("Paragraph") == 5 and "Your" not in got


def test_names_of_article_text_say_nothing():
    got = main_text.main_text(f"<article><h1>Title</h1>{prose('text', 3)}<p class=social-impact>Impact.</p><section id=related-work>Work.</section>"
                              "<table><tr><td class=footer-row>Cell.</td></tr></table><div class=ad>Buy</div></article>").split("\n")
    assert got[0] == "Title" and got[-3:] == ["Impact.", "Work.", "Cell."] and len(got) == 7


LISTS = ("<body><div id=top><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></div><div><a>Home</a> <a>About</a></div>"
         "<h1>Title</h1>{text}<div>All rights reserved</div><div id=bottom><p>Imprint</p></div></body>")


def test_borders_come_from_the_ratios_on_pages_without_article(monkeypatch):
    html = LISTS.replace("{text}", prose("text", 5) + "<p>Short.</p>" + prose("more", 3))
    want = ["Title", *prose("text", 5).replace("</p>", "").split("<p>")[1:], "Short.", *prose("more", 3).replace("</p>", "").split("<p>")[1:]]
    assert main_text.main_text(html).split("\n") == want
    for name, nonsense in (("SPREAD_SHARE", 50), ("CORE_SHARE", 0)):
        with monkeypatch.context() as changed:
            changed.setattr(main_text, name, nonsense)
            assert main_text.main_text(html).split("\n") != want


def test_a_list_of_links_parts_regions_and_a_small_one_elsewhere_goes():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(6)) + "</ul>"
    box = f"<div><div><h1>Title</h1>{prose('text', 30)}{links}{prose('tail', 1)}</div>{links}<div>{prose('box', 1)}</div></div>"
    got = main_text.main_text(f"<body>{box}</body>").split("\n")
    assert len(got) == 32 and "tail" in got[-1] and not any("Link" in line or "box" in line for line in got)


def test_the_card_of_another_story_goes():
    got = main_text.main_text(f"<body><article><h1>Title</h1>{prose('text', 12)}</article><article><h2><a href=/x>Another story</a></h2><p>In short.</p></article></body>")
    assert got.count("\n") == 12 and "Another" not in got and "short" not in got


@pytest.mark.parametrize("tag", ["div", "b", "p class=ad", "div id=comments", "li"])
def test_deep_pages_take_time_in_proportion(tag):
    import time

    began = time.process_time()
    main_text.main_text("<body>" + f"<{tag}>x " * 20_000)
    main_text.main_text("<body>" + f"<{tag}>" * 10_000 + "<p>text</p></b>" * 10_000)
    assert time.process_time() - began < 15
