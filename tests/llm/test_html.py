import time

import pytest

from graphloom.llm.html import extract, main_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T t</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a></header>'
    '<div id="cookie-notice">We use cookies.</div><div class=layout><div class="sidebar"><p>Hot, now, today.</p></div>'
    '<{root}><h1>Big &amp; news</h1><p>First <a href=x>linked words</a> here, and more\n  words, so it is long enough.</p><!-- no -->'
    "<ul><li>one item, yes.</li><li>two</li></ul><script>var a = '<p>x</p>';</script><table><tr><td>c1<td>c2</table>"
    "<p>1 < 2 and <b>bold</b>text &lt;tag&gt;, done.<form><input><label>Mail</label></form><blockquote>Said so, he did.</blockquote></{end}>"
    '<section id="comments"><p>Great, great, great, article. I like it, a lot. Really, yes, indeed.</p></section></div><footer>(c)</footer></body></html>'
)
WANT = "Big & news First linked words here, and more words, so it is long enough. one item, yes. two c1 c2 1 < 2 and boldtext <tag>, done. Said so, he did."


@pytest.mark.parametrize("root", ["article", "main", "div class=post-body", "div", "section"])
def test_main_text(root):
    assert main_text(PAGE.replace("{root}", root).replace("{end}", root.split()[0])) == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""), ("just text & more", "just text & more"), ("<p>a<p>b<div>c</div>", "a b c"), ("<article><p>x", "x"),
        ("<main><aside>no</aside><p>Yes, this.</p></main>", "Yes, this."), ("<p>a&nbsp;&eacute;&#x41;&amp;lt;</p>", "a éA&lt;"),
        ("<article><header><h1>Head</h1></header><p>Body, text.</p><footer>by me</footer></article>", "Head Body, text."),
        ("<article><p>x, y<article class=comment><p>first, comment, here</p></article></article>", "x, y"), ("<!-- only", ""), ("<p title=don't>Stays, here.</p><p>It's all.</p>", "Stays, here. It's all."), ('<p class="x"">One, two.</p><p id="y">Three.</p>', "One, two. Three."),
        ('<p title="a > b">Kept, yes.</p>', "Kept, yes."), ('<p a="open>text, here</p>', "text, here"), ("<article><p data-x='1' hidden>gone</p><p>x, y</p></article>", "x, y"), ("< a < b", "< a < b"),
        ("<div>" * 3000 + "deep, text." + "</div>" * 3000, "deep, text."),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


def test_extract(spark):
    rows = [(1, "u", PAGE.replace("{root}", "article").replace("{end}", "article"), "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "v", "", None), (5, "w", "<p>" + "long, text. " * 60000, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(df).collect()}
    assert got == {(1, "u"): (WANT, len(WANT)), (2, None): ("", 0), (None, "v"): ("", 0), (5, "w"): (("long, text. " * 60000).strip(), 12 * 60000 - 1)}
    assert extract(df).count() == 5 and extract(df.limit(0)).count() == 0


LONG = "<h1>Head</h1>" + "".join(f"<p>Sentence {i}, with words, and a stop. Then one more, as long.</p>" for i in range(6))
HELD = "Head " + " ".join(f"Sentence {i}, with words, and a stop. Then one more, as long." for i in range(6))
SIDE = '<div class="sidebar"><p>Hot, now, today.</p></div><div id="comments"><p>Great, great. I like it.</p></div>'


@pytest.mark.parametrize("names", ["layout has-sidebar", "site sidebar-right", "container fixed-header", "page no-sidebar", "search", "promo"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_a_wrapper_named_after_what_it_has_keeps_its_article(names, inner):
    assert main_text(f'<body><div class="{names}"><{inner}>{LONG}</{inner}>{SIDE}</div><footer>(c) us, all rights.</footer></body>') == HELD


@pytest.mark.parametrize("names", ["post comments-open", "single-post no-comments", "post promo"])
def test_an_article_named_after_its_comments_is_kept(names):
    assert main_text(f'<body><main><article class="{names}">{LONG}</article>{SIDE}</main></body>') == HELD
    assert main_text(f'<body><article class="{names}">{LONG}</article></body>') == HELD


def test_named_elements_beside_the_article_are_left_out():
    more = LONG.replace("Sentence", "Remark") * 3
    assert main_text(f'<body><article>{LONG}</article><section id="comments">{more}</section></body>') == HELD
    assert main_text(f'<body><article>{LONG}</article><div class="sidebar">{more}</div></body>') == HELD
    assert main_text(f'<body><div class="site sidebar-right"><article>{LONG}</article></div><div class="comment-list">{more}</div></body>') == HELD
    assert main_text('<div class="notice"><p>Only this, here.</p></div>') == "Only this, here."


@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_lists_of_links_inside_the_article_are_left_out(inner):
    links = "<ul>" + "".join(f"<li><a href=/{i}>Share it on number {i}</a></li>" for i in range(5)) + "</ul>"
    own = '<p><a href="/x">A linked sentence, as long as the others, of the text.</a></p>'
    want = HELD + " A linked sentence, as long as the others, of the text. Short line"
    assert main_text(f"<body><{inner}>{LONG}{own}<h2>Short line</h2>{links}</{inner}></body>") == want


def test_paths_below_the_threshold_are_left_out_without_article_or_main():
    table = "<table><tr><td>c1<td>c2</table>"
    assert main_text(f"<body><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>{LONG}<dl><dt>a</dt></dl><ol><li>b</li></ol>{table}</body>") == HELD + " a"  # the path beside the text is lifted by the smoothing


@pytest.mark.parametrize("name", ["related-work", "search-results-discussion", "share-price", "social-history", "form-of-government", "header-text-x", "response-time", "promontory", "replying", "cookie-recipes", "reply-brief"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_article_text_under_an_innocent_name_stays(name, inner):
    own = f'<div class="{name}"><p>Prior studies, many, say so.</p></div>'
    assert main_text(f"<body><{inner}>{LONG}{own}</{inner}></body>") == HELD + " Prior studies, many, say so."


@pytest.mark.parametrize("piece", ["<div>some text. ", "<b><div>x", "<p>a<span>", '<div class="comments">y ', "<article><p>t, t.", "<li><a>x</a>", "<table><tr><td>c"])
def test_time_is_linear_in_depth(piece):
    began = time.process_time()
    assert main_text(piece * 50_000) or "comments" in piece
    assert main_text("<div>" * 50_000 + piece + "</section></b></i>" * 50_000 + "</div>" * 50_000)
    assert time.process_time() - began < 40
