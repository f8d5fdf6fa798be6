"""Articles and result links out of raw HTML, on a small tree that the standard tokenizer fills."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BOILERPLATE, CONTROL

# Elements without content, without text of their own, and that stand apart as blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style nav header footer aside form button input select textarea iframe noscript svg path canvas video audio object embed template dialog figcaption".split())
BLOCKS = set("p div section article blockquote pre ul ol li h1 h2 h3 h4 h5 h6 table tr td th figure details summary dd dt dl hr br address".split())
CONTENT = set("p li blockquote pre td h2 h3 h4 h5 h6 dd dt figcaption".split())
RICH = set("blockquote pre code table figure ul ol".split())
CONTAINERS = set("div section td main article".split())
# An element of the first kind ends those of the second that are open.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"})
SCOPES = set("table td th ul ol dl div article section body html button".split())
# Classes and ids of an article's body, kinds of structured data, and names that speak for and against content.
BODY_CLASSES = """post-content entry-content article-body story-body article__body article-text post-body td-post-content post-entry content-body page-content rich-text prose markdown-body
mw-parser-output field-body node__content blog-post-content single-post-content post-text articleBody caas-body article__content story-content post__content""".split()
BODY_IDS = "article-body content main-content post-content story-body mw-content-text".split()
KINDS = "Article NewsArticle BlogPosting TechArticle ScholarlyArticle Report WebPage CreativeWork".split()
FOR = """article content main body text post entry story page prose markdown document paper passage reading hentry blog blog-post single-post article-content article-text article-body ArticleBody
post-content post-text postBody storycontent""".split()
AGAINST = """comment footer sidebar nav menu header breadcrumb widget ad- advert social share related popup modal cookie banner promo newsletter signup subscribe pagination pager toolbar masthead skip-link sidebar
complementary supplementary sponsor outbrain taboola recirculation trending more-stories recommendations you-may-also suggested feedback rating login register print email-article""".split()
_FOR, _AGAINST = (re.compile("|".join(map(re.escape, words)), re.I) for words in (FOR, AGAINST))
_BOILERPLATE, _CONTROL = re.compile(BOILERPLATE), re.compile(CONTROL)
_HIDDEN = re.compile(r"display: ?none|visibility: ?hidden", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    inside: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in the document's order."""
        open_nodes = [self]
        while open_nodes:
            node = open_nodes.pop()
            yield node
            open_nodes += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self) -> str:
        parts: list[str] = []
        rest: list[Node | str] = [self]
        while rest:
            x = rest.pop()
            if isinstance(x, str):
                parts.append(x)
            else:
                rest += reversed(x.inside)
        return "".join(parts)

    def find(self, wanted: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n is not self and wanted(n)]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for closed in ENDS.get(tag, ()):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == closed:
                    del self.open[k:]
                    break
                if self.open[k].tag in SCOPES and self.open[k].tag != closed:
                    break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.open[-1])
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _unseen(node: Node) -> bool:
    return node.tag in UNSEEN or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(node.attrs.get("style", "")))


def visible(node: Node) -> str:
    """What a reader sees: pieces joined by spaces, blocks on lines of their own. Elements may be nested at any depth."""
    if _unseen(node):
        return ""
    path: list[tuple[Node, Iterator[Node | str], list[str]]] = [(node, iter(node.inside), [])]
    while True:
        at, rest, parts = path[-1]
        for x in rest:
            if isinstance(x, str):
                if own := x.strip():
                    parts.append(own)
            elif not _unseen(x):
                path.append((x, iter(x.inside), []))
                break
        else:
            path.pop()
            own = " ".join(parts)
            if not path:
                return own
            if own:
                path[-1][2].append(f"\n{own}\n" if at.tag in BLOCKS else own)


@dataclass
class Sums:
    """Of an element and all below it: bytes that are visible, of text, of markup, and of links' text; numbers of paragraphs and rich elements below."""

    seen: int = 0
    text: int = 0
    markup: int = 0
    links: int = 0
    paragraphs: int = 0
    rich: int = 0


def sums(root: Node) -> dict[int, Sums]:
    """Sums of each element, by its id(): children first, so each element is added up once."""
    found: dict[int, Sums] = {}
    for node in reversed([*root.walk()]):
        own = Sums(markup=2 * len(node.tag) + 5 + sum(len(k) + _bytes(v) + 4 for k, v in node.attrs.items()))
        pieces = []
        for x in node.inside:
            if isinstance(x, str):
                own.text += _bytes(x)
                pieces.append(_bytes(x.strip()))
                continue
            below = found[id(x)]
            own.text += below.text
            own.markup += below.markup
            own.links += below.links + (below.text if x.tag == "a" else 0)
            own.paragraphs += below.paragraphs + (x.tag == "p")
            own.rich += below.rich + (x.tag in RICH)
            pieces.append(below.seen + 2 if below.seen and x.tag in BLOCKS else below.seen)
        if not _unseen(node):
            own.seen = sum(pieces) + max(0, sum(map(bool, pieces)) - 1)
        found[id(node)] = own
    return found


def clean(text: str) -> str:
    """The same rules as functions.text.cleaned(), for text that is in Python already."""
    seen, kept = set(), []
    for part in (p.strip() for p in _CONTROL.sub("", text).replace("\r", "\n").split("\n\n")):
        key = " ".join(part.lower().split())[:80]
        if not part or key in seen:
            continue
        seen.add(key)
        joined = " ".join(x for x in map(str.strip, part.split("\n")) if _bytes(x) >= 3 and not _BOILERPLATE.search(x))
        if _bytes(joined) >= 10:
            kept.append(joined)
    return re.sub(r"\s{3,}", " ", "\n\n".join(kept)).strip()


def _bytes(text: str) -> int:
    return len(text.encode())


def quality(text: str) -> int:
    own = [x.strip() for x in text.splitlines()]
    score = _bytes(text) // 10 + 5 * sum(1 for x in own if _bytes(x) >= 30 and re.search(r"[A-Z].*[.!?]$", x))
    return score - score // 3 if own and sum(_bytes(x) < 15 for x in own) / len(own) > 0.6 else score


def score(node: Node, own: Sums) -> float:
    """How much an element looks like the article: paragraphs, names, density, length, few links, rich parts."""
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    links = own.links / own.text if own.text else 0.0
    total = 3.0 * own.paragraphs + 25.0 * bool(_FOR.search(names)) - 25.0 * bool(_AGAINST.search(names)) + 50.0 * own.text / max(1, own.text + own.markup)
    total += sum(bonus for least, bonus in ((200, 5), (1000, 10), (3000, 15)) if own.text > least)
    total -= 40 if links > 0.5 else 20 if links > 0.3 else 8 if links > 0.15 else 0
    return total + 3.0 * own.rich


def _best(texts: list[str]) -> str:
    """The one of best quality, the first of equals; not one without any."""
    best, most = "", 0
    for text in texts:
        if (q := quality(text)) > most:
            best, most = text, q
    return best


def _structured(n: Node) -> bool:
    return bool(set(n.attrs.get("class", "").split()) & set(BODY_CLASSES)) or n.attrs.get("id") in BODY_IDS or n.attrs.get("data-component") == "text-block"


def _semantic(n: Node) -> bool:
    a = n.attrs
    return n.tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody" or a.get("data-testid") == "article-body" or "Article" in a.get("itemtype", "")


def json_ld(root: Node) -> str:
    """The body, description or text of the first object of a known kind that is long enough."""
    for script in root.find(lambda n: n.tag == "script" and n.attrs.get("type") == "application/ld+json"):
        try:
            value = json.loads(script.text().strip())
        except ValueError:
            continue
        for x in value if isinstance(value, list) else [value]:
            if isinstance(x, dict) and x.get("@type") in KINDS:
                for name, least in (("articleBody", 100), ("description", 50), ("text", 50)):
                    if isinstance(x.get(name), str) and _bytes(x[name].strip()) >= least:
                        return x[name].strip()
    return ""


def _meta(root: Node, name: str, value: str) -> str:
    found = root.find(lambda n: n.tag == "meta" and n.attrs.get(name) == value)
    return found[0].attrs.get("content", "").strip() if found else ""


def title(root: Node, shorten: bool = False) -> str:
    """og:title, <title> (cut at ' - ' and ' | ' if asked), meta title, or the first h1."""
    heads = root.find(lambda n: n.tag == "title")
    own = heads[0].text().strip() if heads else ""
    if shorten:
        own = own.split(" - ")[0].split(" | ")[0].strip()
    h1 = root.find(lambda n: n.tag == "h1")
    return _meta(root, "property", "og:title") or own or _meta(root, "name", "title") or (h1[0].text().strip() if h1 else "")


def described(root: Node) -> str:
    first, second = _meta(root, "property", "og:description"), _meta(root, "name", "description")
    return "\n\n".join(x for x in (first, "" if second in first else second) if x)


def extract(html: str, live: bool = False) -> tuple[str, str, str]:
    """(title, text, strategy): the first strategy whose cleaned text is long enough; ``live`` has other lengths and cuts titles."""
    root = parse(html)

    def scored() -> str:
        known = sums(root)
        boxes = [(score(n, known[id(n)]), n) for n in root.find(lambda n: n.tag in CONTAINERS) if known[id(n)].seen > 100]
        return visible(max(boxes, key=lambda b: b[0])[1]) if boxes else ""

    def elements() -> str:
        own = [visible(n).strip() for n in root.find(lambda n: n.tag in CONTENT) if not _AGAINST.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}")]
        return "\n\n".join(x for x in own if _bytes(x) >= 10)

    ways: list[tuple[str, Callable[[], str], int]] = [
        ("json_ld", lambda: json_ld(root), 100),
        ("structured", lambda: _best([visible(n) for n in root.find(_structured)]), 100),
        ("semantic", lambda: _best([visible(n) for n in root.find(_semantic)]), 80),
        ("scored", scored, 50 if live else 60),
        ("elements", elements, 1 if live else 40),
    ]
    name = title(root, live)
    for way, found, least in ways:
        text = clean(found())
        if _bytes(text) >= least:
            return name, text, way
    if _bytes(text := described(root)) >= 30:
        return name, text, "meta"
    body = root.find(lambda n: n.tag == "body")
    return name, clean(visible(body[0] if body else root)), "body"


def video(html: str, live: bool = False) -> tuple[str, str, str] | None:
    """(title, text, strategy) of a video's page: the description in its JSON, or that in its head if longer than 30 bytes; a live search looks there first."""
    root = parse(html)
    head = _meta(root, "name", "description")
    found = re.search(r'"shortDescription":"((?:\\.|[^"\\])*)"', html)
    own = found[1] if found else ""
    for mark, instead in (("\\n", " "), ('\\"', '"'), ("\\u0026", "&"), ("\\/", "/")):
        own = own.replace(mark, instead)
    ways = [("video_json", own.strip(), live or bool(own.strip())), ("video_meta", head if _bytes(head) > 30 else "", live)]
    for way, text, cut in reversed(ways) if live else ways:
        if text:
            return title(root, cut), text, way
    return None


#: Fixed value: a video's page.
VIDEO = "youtube.com/watch"


def articles(pages: DataFrame, live: bool = False, most_bytes: int = 1_500_000, focus: str | None = None) -> DataFrame:
    """(id, title, text, strategy, n_bytes) of each page (id, html, url if known); a null page gives empty strings.

    Pages are cut at ``most_bytes``, as what is fetched is. Where url or ``focus`` tell that a page shows a video, its description is the text.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = (h or "").encode()[:most_bytes].decode(errors="ignore")
                shown = video(page, live) if focus == "youtube" or VIDEO in (url or "") else None
                rows.append(shown or extract(page, live))
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([_bytes(r[1]) for r in rows], pa.int64())], names=["id", "title", "text", "strategy", "n_bytes"])

    url = F.col("url") if "url" in pages.columns else F.lit(None)
    return pages.select(F.col("id").cast("bigint"), "html", url.cast("string").alias("url")).mapInArrow(extracted, "id bigint, title string, text string, strategy string, n_bytes bigint")


_PART = re.compile(r"^([\w-]+)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:\*='([^']*)')?\]")


@lru_cache(maxsize=256)
def _selector(css: str) -> list[list[Callable[[Node], bool]]]:
    """Alternatives of a list with commas; each a path of tests, the last one for the element itself."""

    def test(compound: str) -> Callable[[Node], bool]:
        parts = [m.groups() for m in _PART.finditer(compound)]

        def holds(n: Node) -> bool:
            for tag, name, own_id, attr, piece in parts:
                if tag and n.tag != tag or name and name not in n.attrs.get("class", "").split() or own_id and n.attrs.get("id") != own_id:
                    return False
                if attr and (attr not in n.attrs or piece is not None and piece not in n.attrs[attr]):
                    return False
            return True

        return holds

    return [[test(c) for c in path.split()] for path in css.split(",")]


def _matches(node: Node, path: list[Callable[[Node], bool]]) -> bool:
    if not path[-1](node):
        return False
    left, above = len(path) - 2, node.parent
    while left >= 0 and above is not None:
        if path[left](above):
            left -= 1
        above = above.parent
    return left < 0


def select(root: Node, css: str) -> list[Node]:
    """Elements below ``root``, in order, that match tags, .classes, #ids and [attributes], with spaces for 'anywhere below'."""
    ways = _selector(css)
    return [n for n in root.walk() if n is not root and any(_matches(n, way) for way in ways)]


def target(href: str) -> str:
    """Where a result link leads, '' if nowhere: itself, the first q= or url= of a /url? link, or uddg=."""
    if href.startswith(("http://", "https://")):
        return href
    if href.startswith("//"):
        return f"https:{href}"
    asked = parse_qsl(urlsplit(href).query, keep_blank_values=True)
    if href.startswith("/url?"):
        for name, value in asked:
            if name in ("q", "url"):
                return value
    return next((unquote(value) for name, value in asked if name == "uddg"), "")


def yahoo_target(href: str) -> str:
    """What stands behind RU= up to the next slash, or behind the last /*; an address elsewhere is itself."""
    if "RU=" in href:
        return unquote(href.split("RU=", 1)[1].split("/", 1)[0])
    if "/*http" in href:
        return "http" + href.rsplit("/*http", 1)[1]
    return href if href.startswith(("http://", "https://")) and "yahoo.com" not in href else ""


Hit = tuple[str, str, str]
#: Where the general reader looks for links, in this order, until it has LINKS_SEEN of them, and the most hits of a page.
PLACES = ("#search a[href]", "article a[href]", "main a[href]", "h2 a[href]", "h3 a[href]", "li a[href]")
LINKS_SEEN, HITS = 120, 40


def result_links(html: str, own: str, most: int = HITS) -> list[Hit]:
    """(url, title, snippet) of any engine's result page: links to other hosts than ``own``, each address once."""
    root, links = parse(html), []
    for place in PLACES:
        links += select(root, place)
        if len(links) > LINKS_SEEN:
            break
    found, known = [], set()
    for n in links:
        url = target(n.attrs["href"])
        if len(found) == most or not url.startswith(("http://", "https://")) or (own and own in url) or url in known:
            continue
        known.add(url)
        if _bytes(title := n.text().strip()) >= 3:
            found.append((url, title, n.attrs.get("aria-label", "")))
    return found


def _outer(root: Node, css: str, begin: str, without: Sequence[str], least: int, once: bool) -> list[Hit]:
    """Links that lead out of an engine's own pages, with a title of ``least`` bytes."""
    found, known = [], set()
    for n in select(root, css):
        url, title = n.attrs.get("href", ""), n.text().strip()
        if url.startswith(begin) and not any(w in url for w in without) and _bytes(title) >= least and not (once and url in known):
            known.add(url)
            found.append((url, title, ""))
    return found


def _boxes(root: Node, box: str, link: str, text: str, led: Callable[[str], str]) -> list[Hit]:
    """A hit for each box: its first link, by where it leads, and its first text."""
    found = []
    for n in select(root, box):
        links, texts = select(n, link), select(n, text)
        url = led(links[0].attrs["href"]) if links and "href" in links[0].attrs else ""
        title = links[0].text().strip() if links else ""
        if url and title:
            found.append((url, title, texts[0].text().strip() if texts else ""))
    return found


def _rows(root: Node) -> list[Hit]:
    """Hits of a table in which a row with a link is followed by one with its snippet."""
    found, title, url = [], "", ""
    for row in select(root, "tr"):
        links = select(row, "a.result-snippet")
        if links:
            if not (href := links[0].attrs.get("href", "/")).startswith("/"):
                url, title = href, links[0].text().strip()
        elif url and title and (cells := select(row, "td.result-snippet")):
            if text := cells[0].text().strip():
                found.append((url, title, text))
            title = url = ""
    return found


def _plain(without: str = "") -> Callable[[str], str]:
    return lambda href: href if href.startswith("http") and not (without and without in href) else ""


# Where engines' own result pages have hits.
READERS: dict[str, Callable[[Node], list[Hit]]] = {
    "brave": lambda r: _boxes(r, "#results .snippet", ".snippet-title a, .result-header a, .heading-serpresult a", ".snippet-description, .snippet-content, .result-snippet", _plain()) or _outer(r, "a[href]", "https://", ["brave.com"], 6, False),
    "yahoo": lambda r: _boxes(r, ".algo-sr, .dd.algo, li.ov-a", "h3 a, .compTitle a, .title a", ".compText p, .fc-falcon, .lh-l", yahoo_target),
    "mojeek": lambda r: _boxes(r, "ul.results-standard li", "a.title, h2 a", "p.s", _plain("mojeek.com")),
    "qwant": lambda r: _outer(r, "a[href]", "https://", ["qwant.com", "google.com", "bing.com"], 5, True),
    "startpage": lambda r: _outer(r, "a.result-link, a[class*='result-link']", "http", ["startpage.com"], 5, False) or _outer(r, "a[href]", "https://", ["startpage.com", "google.com", "bing.com"], 11, True),
    "duckduckgo": _rows,
}


def hits(html: str, engine: str, own: str) -> list[Hit]:
    return READERS[engine](parse(html)) if engine in READERS else result_links(html, own)


def links(pages: DataFrame, own: str = "") -> DataFrame:
    """(id, engine, page, rank, url, title, snippet) of result pages (id, engine, page, html), and a row with rank null of each page without a hit.

    Engines without a reader of their own are read in the general way, without links to the host ``own``, or to that in a column of this name.
    A null page has no hit.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, engine, page, body, host in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = hits(body or "", engine, host or "")
                rows += [(i, engine, page, k, *h) for k, h in enumerate(found, 1)] or [(i, engine, page, None, None, None, None)]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=["id", "engine", "page", "rank", "url", "title", "snippet"])

    host = F.col("own") if "own" in pages.columns else F.lit(own)
    rows = pages.select(F.col("id").cast("bigint"), "engine", F.col("page").cast("int"), "html", host.alias("own"))
    return rows.mapInArrow(listed, "id bigint, engine string, page int, rank int, url string, title string, snippet string")


#: Engines that go on after an empty page, always or after the first one.
GO_ON_FIRST = ("qwant", "startpage")


def merged(found: DataFrame) -> DataFrame:
    """The hits of links() without those behind an engine's first empty page, each address of an engine once, where it came first.

    Engines that are read in the general way go on after empty pages; some others do after an empty first page. Ranks stay those of the page.
    """
    stops = F.col("rank").isNull() & F.col("engine").isin(*READERS) & ~(F.col("engine").isin(*GO_ON_FIRST) & (F.col("page") == 1))
    end = found.where(stops).groupBy("id", "engine").agg(F.min("page").alias("end"))
    kept = found.where("rank is not null").join(end, ["id", "engine"], "left").where("end is null or page < end")
    first = kept.groupBy("id", "engine", "url").agg(F.min_by(F.struct("page", "rank", "title", "snippet"), F.struct("page", "rank")).alias("x"))
    return first.select("id", "engine", "x.page", "x.rank", "url", "x.title", "x.snippet")


def titles(pages: DataFrame) -> DataFrame:
    """(id, title, live_title) of each page (id, html); the live one is cut at ' - ' and ' | '. A null page has empty ones."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [parse(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([title(r, cut) for r in roots], pa.string()) for cut in (False, True))], names=["id", "title", "live_title"])

    return pages.selectExpr("cast(id as bigint) id", "html").mapInArrow(named, "id bigint, title string, live_title string")
