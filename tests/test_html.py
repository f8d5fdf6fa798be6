import json

from lodestar.sources import html

BODY = "This is a sentence that says something about the matter at hand. " * 4


def test_strategies():
    ld = json.dumps([{"@type": "Thing"}, {"@type": "NewsArticle", "articleBody": BODY}])
    cases = {
        "json_ld": f"<script type='application/ld+json'>{ld}</script><p>other</p>",
        "structured": f"<div class='x entry-content'><p>{BODY}</div>",
        "semantic": f"<article><h1>T</h1><p>{BODY}<p>{BODY[:70]} more</article>",
        "scored": f"<div class='post'><span>{BODY}</span></div>",
        "elements": "<ul><li>One line of text that is here<li>Another line of text is here</ul>",
        "meta": f"<meta property='og:description' content='{BODY[:60]}'><b>x</b>",
        "body": "<body><b>tiny but visible</b></body>",
    }
    for way, page in cases.items():
        assert html.extract(page)[2] == way, way
    assert html.extract("") == ("", "", "body")


def test_titles():
    page = "<head><title>Name - Site | More</title></head><h1>Head</h1>"
    assert html.extract(page)[0] == "Name - Site | More" and html.extract(page, live=True)[0] == "Name"
    assert html.extract("<meta property='og:title' content=' Og '><title>x</title>")[0] == "Og"
    assert html.extract("<h1>Only <b>head</b></h1>")[0] == "Only head"


def test_visible_leaves_out_what_is_hidden():
    page = html.parse("<body><p>a<script>var t='</p>';</script><p>b<div style='display: none'>c</div><span hidden>d</span><i aria-hidden='true'>e</i><nav>f</nav>g</body>")
    words = html.visible(page).split()
    assert words == ["a", "b", "g"]


def test_unclosed_elements():
    root = html.parse("<ul><li>a<li>b</ul><p>c<p>d<table><tr><td>e<td>f<tr><td>g</table>")
    assert [n.tag for n in root.inside] == ["ul", "p", "p", "table"] and len(root.find(lambda n: n.tag == "td")) == 3


def test_result_links():
    page = """<nav><a href='https://nav.org'>Not here</a></nav><main><a href='/url?q=https%3A%2F%2Fa.org%2F'>First hit</a><a href='//d.example/?uddg=https%3A%2F%2Fb.org'>Second</a><a href='https://s.example/x'>own</a>
    <a href='https://a.org/'>again</a><a href='https://c.org'>ab</a><a href='/about'>Relative</a></main><ul><li><a href='/l/?uddg=https%3A%2F%2Fe.org%252Fp'>Last</a></ul>"""
    assert [(u, t) for u, t, _ in html.result_links(page, "s.example")] == [("https://a.org/", "First hit"), ("https://d.example/?uddg=https%3A%2F%2Fb.org", "Second"), ("https://e.org/p", "Last")]
    many = "<main>" + "".join(f"<a href='https://m.org/{i}'>Title {i}</a>" for i in range(130)) + "</main><li><a href='https://late.org'>Too late</a>"
    assert len(html.result_links(many, "")) == 40


def test_selectors():
    root = html.parse("<div id='a' class='x y'><p><a href='1'>i</a></p></div><div class='y'><a>j</a><a class='zz-result-link-1' href='2'>k</a></div>")
    texts = lambda css: [n.text() for n in html.select(root, css)]
    assert texts("#a a") == ["i"] and texts(".y a[href]") == ["i", "k"] and texts("a[class*='result-link']") == ["k"] and texts(".x.y p a, div.y a") == ["i", "j", "k"]


def test_engine_pages():
    assert html.hits("<div id='results'></div><a href='https://a.org'>A longer title</a><a href='https://brave.com'>Own page here</a><a href='https://b.org'>short</a>", "brave", "") == [("https://a.org", "A longer title", "")]
    assert html.hits("<li class='ov-a'><h3><a href='https://x.yahoo.com/a/*https://b.org/p'>T</a></h3></li><div class='algo-sr'><h3><a href='https://c.yahoo.com'>own</a></h3></div>", "yahoo", "") == [("https://b.org/p", "T", "")]
    assert html.hits("<a href='https://a.org'>A title that is long</a><a href='https://a.org'>A title that is long</a><a href='https://b.org'>ten chars.</a>", "startpage", "") == [("https://a.org", "A title that is long", "")]
    rows = "<table><tr><td><a class='result-snippet' href='/own'>x</a></td></tr><tr><td class='result-snippet'>lost</td></tr><tr><td><a class='result-snippet' href='https://a.org'> T </a></td></tr><tr><td>between</td></tr><tr><td class='result-snippet'> S </td></tr></table>"
    assert html.hits(rows, "duckduckgo", "") == [("https://a.org", "T", "S")]


def test_pages_behind_an_empty_one(spark):
    page = "<a href='https://a.org/{0}'>Title of {0}</a>"
    rows = [(1, e, p, "" if p in empty else f"<main>{page.format(p)}</main>") for e, empty in (("qwant", (1, 3)), ("bing", (2,)), ("brave", (1,))) for p in (1, 2, 3, 4)]
    found = html.merged(html.links(spark.createDataFrame(rows, "id bigint, engine string, page int, html string")))
    assert {(r["engine"], r["page"]) for r in found.collect()} == {("qwant", 2), ("bing", 1), ("bing", 3), ("bing", 4)}


def test_deep_nesting_and_scores_by_hand():
    deep = "<div>" * 5000 + f"<p>{BODY}</p>" + "</div>" * 5000
    name, text, way = html.extract(f"<title>Deep</title>{deep}")
    assert name == "Deep" and text.startswith("This is a sentence")
    root = html.parse("<div class='post'><p>one <a href='#'>two</a></p><ul><li hidden>three</li><li>four</li></ul></div>")
    found = html.sums(root)
    for node in root.walk():
        below = [n for n in node.walk() if n is not node]
        own = found[id(node)]
        assert own.seen == len(html.visible(node).encode()) and own.text == len(node.text().encode())
        assert own.links == sum(len(n.text().encode()) for n in below if n.tag == "a") and own.paragraphs == sum(n.tag == "p" for n in below) and own.rich == sum(n.tag in html.RICH for n in below)


def test_videos():
    page = "<title>V - Site</title><meta name='description' content='A description of more than thirty bytes'><script>x={\"shortDescription\":\"say \\\"hi\\\" \\u0026 go\"}</script>"
    assert html.video(page) == ("V", 'say "hi" & go', "video_json") and html.video(page, live=True)[1].startswith("A description")
    assert html.video("<meta name='description' content='short'>") is None
