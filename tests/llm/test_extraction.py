import html
import re

import duckdb

from logspark.llm import extraction as ex
from logspark.llm.queries import QUERIES


def article(page):
    """What stands in the article element of the generated pages, by plain replacement."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1]
    body = re.sub(r"<(script|style)\b.*?(</\1>|\Z)|<!--.*?-->|<footer>.*", "", body, flags=re.DOTALL)
    body = re.sub(r"</?(b|i|em|a)\b[^>]*>", "", body)
    return " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", body)).split())


def test_query_reads_the_articles(spark):
    folder = "/root/testdata/sf0.1"
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall())
    got = QUERIES["op5_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    wrong = [(r.page_id, r.text[:200], article(pages[r.page_id])[:200]) for r in got if r.text != article(pages[r.page_id])]
    assert not wrong, (len(wrong), wrong[:2])
    assert all(r.n_chars == len(r.text) for r in got)


def test_parts_that_are_not_content():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><div class="layout"><article><header><h1>A &lt;Title&gt; &amp; more</h1></header>
    <p>One<b>two</b>&nbsp;three<br>four<p>five <script>var x = "</p>";</script>six<form><input value=1>send</form>
    <ul><li>item 1<li>item 2</ul><table><tr><td>a<td>b</table><!-- <p>hidden</p> --><div id=comments><p>nice!</p></div>
    <aside>see also</aside><p hidden>secret</p></article></div><section class="comments"><article class="comment">me too, and me too, and me too again</article></section>
    <div class='ad'>buy</div><footer>(c)</footer></body></html>"""
    assert ex.extract(page) == "A <Title> & more Onetwo three four five six item 1 item 2 a b"
    assert ex.extract("<main><p>x</p></main><p>y</p>") == "x"
    assert ex.extract("<p>a < b</p><p>c") == "a < b c"
    assert ex.extract("plain &eacute; text") == "plain é text"
    assert ex.extract("<p>x</p><!-- open <p>y</p>") == "x"
    assert ex.extract("<script>x") == "" and ex.extract(None) == "" and ex.extract("") == ""


def page(i):
    return (f"<html><body><div><p>Site of things</p><p>You are here</p></div><div><h1>Story {i}</h1>"
            + "".join(f"<p>Sentence {i} {k} with words of its own {i * k}</p>" for k in range(4 + i % 3))
            + "<p>Sign up below</p></div></body></html>")


def test_wrapper_drops_constant_nodes_and_keeps_slots(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)]
    rows += [(100, None, None), (101, "http://h.example/x", ""), (102, "nonsense", "<p>alone</p>"), (5, "http://h.example/5", page(5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper")
    got = {r.page_id: r.main_text for r in ex.main_text(df).collect()}
    for i in range(30):
        want = f"Story {i} " + " ".join(f"Sentence {i} {k} with words of its own {i * k}" for k in range(4 + i % 3))
        assert got[i] == want
    assert (got[100], got[101], got[102]) == ("", "", "alone")
    assert ex.main_text(df).columns == [*df.columns, "main_text"]
    assert ex.main_text(df.limit(0)).count() == 0


def test_near_copies_are_no_template():
    pages = [page(3).replace("words of its own 3", f"words of its own {n}") for n in range(6)]
    assert ex.induce(pages) is None
    assert ex.induce([page(1)] * 9) is None


def test_tree_matching_is_the_largest_alignment():
    a = ex.parse("<div><p>1</p><ul><li>a<li>b</ul><p>2</p></div>")
    b = ex.parse("<div><ul><li>a</ul><h2>x</h2><p>2</p></div>")
    size, pairs = ex.matched(a, b)
    assert size == len(pairs) == 5


def other_page(i):
    return (f"<html><body><section><h2>Gallery {i}</h2><ul>" + "".join(f"<li>Picture {i} {k} shows {i * k} things of note</li>" for k in range(5))
            + "</ul><blockquote>Join the club today</blockquote></section></body></html>")


def near_copy(i):
    return page(3).replace("words of its own 3", f"words of its own {i}")


def test_constants_are_counted_over_all_pages_of_all_layouts(spark):
    # two layouts, and near copies of one page that outnumber the other pages of the first layout
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    rows += [(1000 + i, f"http://h.example/{i}", near_copy(i)) for i in range(60)]
    rows += [(2000 + i, f"http://h.example/g{i}", other_page(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.main_text for r in ex.main_text(df).collect()}
    assert all("Sign up" not in t and "Site of" not in t and "club" not in t for t in got.values())
    assert got[4] == "Story 4 " + " ".join(f"Sentence 4 {k} with words of its own {4 * k}" for k in range(5))
    assert all(got[1000 + i].count("Sentence 3") == 4 and "Story 3" in got[1000 + i] for i in range(60))
    assert all(got[2000 + i].count("Picture") == 5 and got[2000 + i].startswith(f"Gallery {i} ") for i in range(40))


def test_all_articles_and_what_stands_beside_them():
    two = "<body><nav>Home</nav><article><h2>One</h2><p>first text</article><article><h2>Two</h2><p>second and longer text</article><footer>c</footer>"
    assert ex.extract(two) == "One first text Two second and longer text"
    beside = "<body><main><h1>Headline</h1><p class=lead>Lead</p><article><p>Body of the story</p></article><div class=related>More</div></main><p>x"
    assert ex.extract(beside) == "Headline Lead Body of the story"
    assert ex.extract("<main><p>in main</main><article><p>after it</article>") == "in main after it"


def test_names_that_tell_of_the_layout_or_of_content():
    side = "<body><div class='content has-sidebar'><p>All the text of the page</p><div class=sidebar>links</div></div>"
    assert ex.extract(side) == "All the text of the page"
    inside = ("<article><div class='post-header'><h1>Headline</h1></div><p class='notice'>A notice</p><section id='search-results'><p>Hit</p></section>"
              "<div class='share'>Share</div></article>")
    assert ex.extract(inside) == "Headline A notice Hit"
    assert ex.extract("<div class='widget'><p>The whole text of this page</p></div><p>short</p>") == "The whole text of this page short"
    assert ex.extract("<div class='widget'><p>tiny</p></div><p>The whole text of this page</p>") == "The whole text of this page"
    assert ex.extract("<p>Text</p><div class='comments'><p>a long comment of a reader, longer than the text</p></div>") == "Text"


def test_deep_and_long_pages():
    deep = ["<div><b>" * 2000 + f"text {i}" for i in range(5)]
    assert ex.extract(deep[0]) == "text 0"
    assert ex.induce(deep) is None
    size, pairs = ex.matched(ex.parse("<br>" * 20_000 + "<p>a</p>"), ex.parse("<br>" * 19_000 + "<p>b</p>"))
    assert size == len(pairs) == 19_002


def layout_page(layout, i):
    # twelve layouts: their block elements nest in ways of their own
    tags = ["section", "ul", "blockquote", "dl", "table", "details", "figure", "ol", "pre", "address", "center", "dir"]
    a, b = tags[layout], tags[(layout * 5 + 3) % 12]
    inner = "".join(f"<{a}><{b}><{a}>Layout {layout} story {i} {k} of {i * k} things</{a}></{b}></{a}>" for k in range(1 + i % 3))
    return f"<html><body><{a}><{b}>Join club {layout} today</{b}>{inner}</{a}></body></html>"


def test_every_layout_of_a_host_is_found_among_all_pages(spark):
    # more layouts than pages were once sampled, some of them rare
    rows = [(100 * layout + i, "http://h.example/x", layout_page(layout, i)) for layout in range(12) for i in range(5 if layout % 2 else 30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.main_text for r in ex.main_text(df).collect()}
    for layout in range(12):
        for i in range(5 if layout % 2 else 30):
            assert got[100 * layout + i] == " ".join(f"Layout {layout} story {i} {k} of {i * k} things" for k in range(1 + i % 3))


def test_references_in_rounds_are_those_of_one_process(spark):
    pages = [layout_page(layout, i) for layout in range(12) for i in range(6)] + ["", "no elements"] + [page(i) for i in range(9)]
    df = spark.createDataFrame([("h", p) for p in pages] + [("few", p) for p in pages[:3]], "host string, html string")
    keyed = df.selectExpr("host", "html", "xxhash64(html) AS key").repartition(5)
    want = None
    for most in (1000, 2):
        got = [(r.host, r.rank, r.key) for r in ex.reference_pages(keyed, 4, most).orderBy("host", "rank", "key").collect()]
        assert {host for host, _, _ in got} == {"h"} and len(got) == 13
        assert want in (None, got)
        want = got
    html = {r.key: r.html for r in keyed.collect()}
    one = ex.Layouts.of([html[k] for k in sorted(html)])
    assert one == [ex.Layouts.flat(ex.parse(html[k])) for _, _, k in want]
