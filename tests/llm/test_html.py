import random
import re
from html import unescape

from meshwork.llm import html as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>One <b>bold</b> and
  <a href="/x">link</a>.<p>Two<br>lines</p><ul><li>i1<li>i2</ul><div class="ad">Buy</div><form>f<input></form>
<script>var a="</p><p>no";</script><!-- <p>hidden</p> --><blockquote>Quote &#8212; end</blockquote></article>
<section class="comments"><p>First!</p></section></main><aside>side</aside><footer>foot</footer></body></html>"""


def text_of(source, wrapper=None):
    return h.extract(h.read_page(source), wrapper)


def test_blocks_of_the_article():
    assert text_of(PAGE) == "Title & more\nOne bold and link.\nTwo lines\ni1\ni2\nQuote — end"


def test_odd_markup():
    assert text_of("") == "" and text_of("plain &lt; text") == "plain < text"
    assert text_of("<article><p>a<p>b</article><footer>x") == "a\nb"
    assert text_of("<article>" + "<div>" * 300 + "deep") == "deep"
    assert text_of("<article><p title='a>b'>x</p><p>1 < 2</p></article>") == "x\n1 < 2"


def test_wrappers_align_to_optional_and_repeated_groups():
    a = h._settle(h.read_page("<div><p>x</p><p>y</p><h2>t</h2></div>"))
    b = h._settle(h.read_page("<div><p>x</p><table><tr><td>1</table></div>"))
    div = h.align(a, b).children[0]
    assert [(c.name, c.optional, c.repeated) for c in div.children] == [("p", False, True), ("h2", True, False), ("table", True, False)]
    assert h.Group.load(div.dump()).dump() == div.dump()


def test_template_text_is_dropped_on_pages_without_article(spark):
    pages = [(i, f"http://a.b/{i}", f"<body><div class=top>Welcome</div><div class=body><p>Story {i}</p></div></body>") for i in range(5)]
    pages += [(7, "http://c.d/", None), (8, None, ""), (9, "http://a.b/9", PAGE), (9, "http://a.b/9", PAGE)]
    df = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, wrapper string").repartition(3)
    rows = sorted(((r.page_id, r.text) for r in h.extract_main_text(df).collect()))
    assert rows[:5] == [(i, f"Story {i}") for i in range(5)]
    assert [t for i, t in rows if i in (7, 8)] == ["", ""] and len(rows) == 9
    assert h.extract_main_text(df.where("false")).count() == 0


def test_query_against_the_article_element(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = h.op4_html(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b), r.page_id
        assert r.n_chars == len(r.text)


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://{url}", source) for i, (url, source) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in h.extract_main_text(df).orderBy("page_id").collect()]


def test_slots_decide_on_pages_with_an_article_too(spark):
    page = "<body><div class=top>Welcome</div><div class=story><p>Story {0}</p></div><div class=teasers><article><p>Teaser {0}</p><p>Read on</p></article></div></body>"
    assert texts_of(spark, [(f"a.b/{i}", page.format(i)) for i in range(4)]) == [f"Story {i}\nTeaser {i}\nRead on" for i in range(4)]


def test_a_template_needs_two_different_pages(spark):
    page = "<body><div class=top>Welcome</div><div class=body id=post-{0}><p>Story {0}</p><div id=n{0}>Note</div></div></body>"
    whole = [("one.page/", page.format(0)), ("two.copies/1", page.format(1)), ("two.copies/2", page.format(1).replace("<body>", "<body><nav>2</nav>"))]
    assert texts_of(spark, whole) == ["Welcome\nStory 0\nNote", "Welcome\nStory 1\nNote", "Welcome\nStory 1\nNote"]
    # groups that differ only in an id of their page meet, and their own texts vary
    assert texts_of(spark, [(f"c.d/{i}", page.format(i)) for i in range(3)]) == [f"Story {i}" for i in range(3)]
    own = "<body><div class=top>Welcome</div><div id=post-{0}>Body {0}</div><div class='box postid-{0}'>Same</div></body>"
    assert texts_of(spark, [(f"e.f/{i}", own.format(i)) for i in range(3)]) == [f"Body {i}" for i in range(3)]


def test_names_that_only_hold_a_word_drop_nothing():
    for start in ('<main class="no-sidebar">', '<article class="post has-comments">', '<div class="content with-sidebar">', '<article class="sponsored-by-none header-large">', '<article class="comments" id="ad">', '<main id="search">'):
        assert text_of(f"<body>{start}<p>Body</p>") == "Body", start
    source = '<article><h2 id="related-work">Related work</h2><p>a</p><section id="search-methods"><h3 id="search">Search</h3>b</section><section id="search">c</section></article>'
    assert text_of(source) == "Related work\na\nSearch\nb\nc"
    assert text_of(source.replace("article", "main")) == "Related work\na\nSearch\nb\nc"
    assert text_of('<article>a</article><h2 id="social">b</h2><div class="social-history">c') == "a\nb\nc"


def test_whole_names_and_their_forms_are_dropped():
    for name in ("sidebar", "site-header", "cookie-bar", "ad-300x250", "ad_slot", "comment-list", "post-comments", "related-posts", "main-nav", "newsletter-signup", "comment-12"):
        for attribute in ("class", "id"):
            assert text_of(f'<body><div>a</div><div {attribute}="x {name}">b</div>c<span class="{name}">d</span>') == "a\nc", name
    assert text_of('<main><article>a</article><section id="comments">b</section></main><div role="complementary">c</div>') == "a"
    assert text_of('<article>a<section class="comments">b</section></article>') == "a"


def test_quotes_open_values_only_after_an_equals_sign():
    assert text_of("<article><p data-x=it's>one</p><p>two</p><p>three's</p></article>") == "one\ntwo\nthree's"
    assert text_of('<article><p "x>one</p><p a = "b>c" d=\'e>f\' g=h"i>two</p></article>') == "one\ntwo"
    assert text_of('<article><a href=/x?y="z>link</a> more</article>') == "link more"


def test_very_deep_pages(spark):
    deep = "<div>" * 10_000 + "deep" + "</div>" * 10_000 + "after"
    assert text_of(f"<article>{deep}</article><footer>x") == "deep\nafter"
    assert text_of("<body>" + "<div>" * 2_000 + "a<nav>menu<div>menu</div></nav>b" + "</div>" * 2_000 + "<footer>x</footer>c") == "a\nb\nc"
    pages = [(f"deep.er/{i}", f"<p>Same</p>{deep.replace('deep', f'deep {i}')} {i}") for i in range(3)]
    assert texts_of(spark, pages) == [f"deep {i}\nafter {i}" for i in range(3)]


def test_the_wrapper_decides_without_any_article(spark):
    """Against a plain count: a text at one place that several pages share is template, all others stay."""
    pages = []
    for i in range(12):
        extra = f"<p>Extra {i}</p>" if i % 3 == 0 else ""
        pages.append((f"h.i/{i}", f"<body><div class=brand>Brand</div><div class=story><h2>Title {i}</h2><p>Text {i}</p>{extra}</div><div class=legal>All rights</div></body>"))
    expected = [f"Title {i}\nText {i}" + (f"\nExtra {i}" if i % 3 == 0 else "") for i in range(12)]
    assert texts_of(spark, pages) == expected
    assert [text_of(source) for _, source in pages] == [f"Brand\n{t}\nAll rights" for t in expected]  # without the wrapper nothing is known to be template


def plain_pairs(x, y):
    """The usual table of common subsequences, and the way through it."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def test_pairs_equal_those_of_the_usual_table():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ([rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(40))] for _ in range(2))
        assert list(h._paired(x, y)) == plain_pairs(x, y)


def test_very_many_siblings_align(spark):
    rng = random.Random(7)
    body = lambda page, n: "".join(f"<{rng.choice(['p', 'ul', 'h2'])}>x{page} {k}" for k in range(n))
    pages = [(f"many.siblings/{k}", f"<body><div class=top>Top</div><div class=story>{body(k, 20_000)}</div></body>") for k in range(2)]
    texts = texts_of(spark, pages)
    assert [t.count("\n") for t in texts] == [19_999] * 2 and not any("Top" in t for t in texts)
