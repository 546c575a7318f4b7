"""Main text of pages: against a plain reading of the tables' own pages, and of hand-made ones."""

import html
import re

from foliant.llm import html_extract as H


def text(page):
    return H.text_of(H.parse(page))


ARTICLE = "<article><h1>A  title</h1><p>One <b>two</b>\n three &amp; &eacute;.</p><p>Four<br>five<p>Six</article>"


def test_parts_that_are_never_text():
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>'</script></head><body class='has-sidebar'><header>Site</header><nav><ul><li>Menu</ul></nav><!-- note --><div class='ad'>Buy</div><div id='cookie-notice'>Cookies</div><aside>Side</aside>{ARTICLE}<section class='comments'><article class='comment'>Reader</article></section><form><p>Mail</form><footer>&copy; x</footer>"
    assert text(page) == "A title\nOne two three & é.\nFour five\nSix"


def test_wrappers_and_pages_without_article():
    assert text(f"<div class='page has-sidebar'>{ARTICLE}</div>").startswith("A title")
    assert text("<body><div class='menu'>m</div><div><p>Plain</p>text</div></body>") == "Plain\ntext"
    assert text("<main><p>In</p><aside>no</aside></main><p>out</p>") == "In"
    assert text("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><pre>k  l</pre>") == "a\nb\nc\nx\ny\nk l"


def test_odd_pages():
    assert text("<") == "<" and text("") == text("   ") == text("<p") == text("<!-- open <p>x</p>") == ""
    assert text("no markup &lt;b&gt; &#65;&#x42; &nope; 5 < 6") == "no markup <b> AB &nope; 5 < 6"
    assert text("<p>a</div></section>b</p><script>x") == "ab"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<article><p>cut off &am") == "cut off &am"


def plain(page):
    body = page.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == plain(r["html"]) and got[r["page_id"]]["n_chars"] == len(plain(r["html"]))


def test_recurring_subtrees_go(spark):
    box = "<div class='x1'><p>Join our club {}</p></div>"
    rows = [(i, "http://a.nl/x", f"<body>{box.format(i)}<div><p>Text {chr(97 + i % 26)}{chr(97 + i // 26)} own</p></div></body>", "z") for i in range(60)]
    rows += [(100, "http://b.nl/x", f"<body>{box.format(1)}</body>", "z"), (101, None, None, "z"), (102, "", "", "z"), (102, "", "", "z")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r["page_id"]: r["text"] for r in H.extract(table).collect()}
    assert got[0] == "Text aa own" and got[59] == "Text hc own" and got[100] == "Join our club 1" and got[101] == got[102] == ""
    assert H.extract(table).count() == len(rows) and H.extract(table.limit(0)).count() == 0


def test_articles_blocks_are_never_template(spark):
    rows = [(i, "http://a.nl", "<article><p>The same passage</p></article>") for i in range(40)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"The same passage"}


def test_wrapped_articles_stay(spark):
    wraps = ["<div id='content'>{}</div>", "<div><p>Constant</p><div class='x'>{}</div></div>", "<section><main>{}</main></section>"]
    rows = [(100 * k + i, f"http://h{k}.nl/{i}", f"<body><div class='x1'>Join</div>{w.format(f'<article><p>Own {chr(97 + i)}</p></article>')}</body>") for k, w in enumerate(wraps) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * k + i: f"Own {chr(97 + i)}" for k in range(3) for i in range(20)}


def test_attributes_are_read_one_after_the_other():
    assert text('<article class="post share">A text</article>') == "A text"
    assert text('<article><p title="the hidden gem">kept</p><p data-hidden="false">too</p><p hidden>not</p></article>') == "kept\ntoo"
    assert text("<article><p data-class='ad' alt=\"class='ad'\" id=x>kept</p><p class=ad>not</p></article>") == "kept"
    assert text('<article><section class="comment-free legal">kept</section><div id="cookie-notice">not</div></article>') == "kept"


def letters(i):
    return "".join(chr(97 + int(c)) for c in f"{i:04d}")


def site(spark, pages, url="http://a.nl/"):
    rows = [(i, f"{url}{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_recurrence_decides_within_articles(spark):
    box = "<div class='x7'><p>Join our club {}</p></div>"
    own = "<div class='x8'><p>Own {}</p></div>"
    page = "<body><p>Menu {}</p><article><h1>T {}</h1><p>Shared passage</p>" + box + own + "<section>Read this too</section><p>End {}</p></article></body>"
    got = site(spark, [page.format(letters(i), letters(i), i, letters(i), letters(i)) for i in range(40)])
    assert got == {i: f"T {letters(i)}\nShared passage\nOwn {letters(i)}\nEnd {letters(i)}" for i in range(40)}
    few = site(spark, [page.format(letters(i), letters(i), i, letters(i), letters(i)) for i in range(4)])  # no template yet
    assert few[0] == "T aaaa\nShared passage\nJoin our club 0\nOwn aaaa\nRead this too\nEnd aaaa"


def test_names_alone_decide_nothing_where_pages_can_be_counted(spark):
    rare = "<article><p>Own {}</p><div class='share-price'>Price {}</div></article>"
    often = "<article><p>Own {}</p><div class='my-comments'>Reader says {}</div></article>"
    plain = "<article><p>Own {}</p></article>"
    pages = [(rare if i == 3 else often if i % 2 else plain).format(letters(i), letters(i)) for i in range(40)]
    got = site(spark, pages)
    assert got == {i: f"Own {letters(i)}" + (f"\nPrice {letters(i)}" if i == 3 else "") for i in range(40)}


def test_boxes_on_a_small_share_of_a_large_host(spark):
    body = "<body>{}<div><p>Text {} and its own words</p></div></body>"
    got = site(spark, [body.format("<div class='x1'>Sale now {}</div>".format(i) if i % 20 == 0 else "", letters(i)) for i in range(200)])
    assert got == {i: f"Text {letters(i)} and its own words" for i in range(200)}


def test_copies_of_a_page_are_no_template(spark):
    copy = "<body><div class='text'><p>Copied often</p></div></body>"
    got = site(spark, [copy] * 60 + [f"<body><div class='text'><p>Own {letters(i)}</p></div></body>" for i in range(20)])
    assert got[0] == got[59] == "Copied often" and got[60] == "Own aaaa"
