"""Search engines as data: addresses of their result pages, their JSON answers, and what is kept of past searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import ENGINE_SETS
from ..functions.text import let
from ..operators import fusion

# Names of the engines that are asked if none are given.
DEFAULT = """wikipedia,duckduckgo,duckduckgo_html,duckduckgo_news,duckduckgo_images,duckduckgo_videos,brave,brave_news,yahoo,yahoo_news,bing,bing_news,bing_images,bing_videos,bing_us,bing_uk,bing_in,bing_de,bing_fr,
bing_es,bing_it,bing_jp,bing_ca,bing_au,bing_nl,bing_se,bing_no,bing_fi,google,google_news,google_scholar,google_images,google_videos,google_us,google_uk,google_in,google_de,google_fr,google_es,google_it,google_br,
google_jp,google_ca,google_au,google_nl,google_se,google_no,google_fi,qwant,startpage,mojeek,yandex,yandex_ru,yandex_global,baidu,baidu_cn,ecosia,ecosia_de,ecosia_fr,metager,metager_de,swisscows,swisscows_ch,ask,
ask_us,aol,aol_search,lycos,dogpile,gibiru,searchencrypt,presearch,yep,mwmbl,sogou,sogou_cn,naver,daum,seznam,rambler,searchalot,excite,webcrawler,info,pipilika,kiddle,marginalia,wiby,right_dao,stract"""

# Hosts by the end of a name.
GOOGLE_HOSTS = {
    "_uk": "www.google.co.uk", "_in": "www.google.co.in", "_de": "www.google.de", "_fr": "www.google.fr", "_es": "www.google.es", "_it": "www.google.it", "_br": "www.google.com.br", "_jp": "www.google.co.jp",
    "_ca": "www.google.ca", "_au": "www.google.com.au", "_nl": "www.google.nl", "_se": "www.google.se", "_no": "www.google.no", "_fi": "www.google.fi",
}

# Fixed values: (beginning of the name, part of it, address, pages), first match first; {host} is Google's.
TEMPLATES = [
    ("google", "_news", "https://{host}/search?q={query}&tbm=nws&start={offset}", 3), ("google", "_images", "https://{host}/search?q={query}&tbm=isch&start={offset}", 2),
    ("google", "_videos", "https://{host}/search?q={query}&tbm=vid&start={offset}", 2), ("google", "_scholar", "https://scholar.google.com/scholar?q={query}&start={offset}", 3),
    ("google", "", "https://{host}/search?q={query}&start={offset}", 3),
    ("bing", "_news", "https://www.bing.com/news/search?q={query}&first={offset}", 3), ("bing", "_images", "https://www.bing.com/images/search?q={query}&first={offset}", 2),
    ("bing", "_videos", "https://www.bing.com/videos/search?q={query}&first={offset}", 2), ("bing", "", "https://www.bing.com/search?q={query}&first={offset}", 3),
    ("duckduckgo", "", "https://html.duckduckgo.com/html/?q={query}&s={offset}", 3),
    ("brave", "_news", "https://search.brave.com/news?q={query}&offset={offset}", 3), ("brave", "", "https://search.brave.com/search?q={query}&source=web&offset={offset}", 3),
    ("yahoo", "_news", "https://news.search.yahoo.com/search?p={query}&b={offset}", 3), ("yahoo", "", "https://search.yahoo.com/search?p={query}&b={offset}", 3),
    ("yandex", "", "https://yandex.com/search/?text={query}&p={page}", 2), ("baidu", "", "https://www.baidu.com/s?wd={query}&pn={offset}", 2), ("ecosia", "", "https://www.ecosia.org/search?q={query}&p={page}", 2),
    ("metager", "", "https://metager.org/meta/meta.ger3?eingabe={query}", 2), ("swisscows", "", "https://swisscows.com/web?query={query}", 2), ("ask", "", "https://www.ask.com/web?q={query}", 2),
    ("aol", "", "https://search.aol.com/aol/search?q={query}", 2), ("lycos", "", "https://search.lycos.com/web/?q={query}", 2), ("dogpile", "", "https://www.dogpile.com/serp?q={query}", 2),
    ("gibiru", "", "https://gibiru.com/results.html?q={query}", 2), ("searchencrypt", "", "https://www.searchencrypt.com/search?eq={query}", 2), ("presearch", "", "https://presearch.com/search?q={query}", 2),
    ("yep", "", "https://yep.com/web?q={query}", 2), ("mwmbl", "", "https://mwmbl.org/?q={query}", 2), ("sogou", "", "https://www.sogou.com/web?query={query}&page={page}", 2),
    ("naver", "", "https://search.naver.com/search.naver?query={query}", 2), ("daum", "", "https://search.daum.net/search?q={query}", 2), ("seznam", "", "https://search.seznam.cz/?q={query}", 2),
    ("rambler", "", "https://nova.rambler.ru/search?query={query}", 2), ("searchalot", "", "https://www.searchalot.com/result?q={query}", 2), ("excite", "", "https://results.excite.com/serp?q={query}", 2),
    ("webcrawler", "", "https://www.webcrawler.com/serp?q={query}", 2), ("info", "", "https://www.info.com/serp?q={query}", 2), ("pipilika", "", "https://www.pipilika.com/search?q={query}", 2),
    ("kiddle", "", "https://www.kiddle.co/s.php?q={query}", 2), ("marginalia", "", "https://search.marginalia.nu/search?query={query}", 2), ("right_dao", "", "https://rightdao.com/search?q={query}", 2),
    ("stract", "", "https://stract.com/search?q={query}", 2), ("alexandria", "", "https://alexandria.org/?q={query}", 2), ("4get", "", "https://4get.ca/web?s={query}", 2),
    ("whoogle", "", "https://whoogle.io/search?q={query}", 2), ("librex", "", "https://librex.devol.it/search.php?q={query}&type=text", 2), ("yacy", "", "https://yacy.searchlab.eu/yacysearch.html?query={query}", 2),
    ("mullvad_leta", "", "https://leta.mullvad.net/?q={query}", 2),
]


# Other names of engines that have result pages of their own.
ALIASES = {
    "duckduckgo": ["duckduckgo", "duckduckgo_html", "duckduckgo_news", "duckduckgo_images", "duckduckgo_videos"],
    "brave": ["brave", "brave_news"],
    "yahoo": ["yahoo", "yahoo_news"],
}
# Fixed values: (address, form that is sent, pages, first offset, offset from page to page) of these engines.
OWN = {
    "wikipedia": ("https://en.wikipedia.org/w/api.php?action=opensearch&search={query}&limit=20&namespace=0&format=json", None, 1, 0, 0),
    "wiby": ("https://wiby.me/json/?q={query}", None, 1, 0, 0),
    "duckduckgo": ("https://lite.duckduckgo.com/lite/", "q={query}&s={offset}&dc={next}", 2, 0, 20),
    "brave": ("https://search.brave.com/search?q={query}&source=web&offset={offset}", None, 3, 0, 10),
    "yahoo": ("https://search.yahoo.com/search?p={query}&n=20&b={offset}", None, 5, 1, 10),
    "qwant": ("https://www.qwant.com/?q={query}&t=web&offset={offset}", None, 3, 0, 10),
    "mojeek": ("https://www.mojeek.com/search?q={query}&s={offset}", None, 5, 1, 10),
    "startpage": ("https://www.startpage.com/sp/search", "query={query}&cat=web&language=english&page={page}", 5, 0, 10),
}


def enabled(spark: SparkSession, names: str = DEFAULT) -> DataFrame:
    """(ord, engine) of a list with commas: trimmed, in lower case, without empty ones."""
    one = spark.range(1).select(F.posexplode(F.filter(F.transform(F.split(F.lit(names), ","), lambda n: F.lower(F.regexp_replace(n, r"\s", ""))), lambda n: n != "")).alias("ord", "engine"))
    return one


def implementation(name: Column) -> Column:
    """The engine that answers under a name."""
    out = name
    for engine, names in ALIASES.items():
        out = F.when(name.isin(*names), engine).otherwise(out)
    return out


def template(engine: Column) -> tuple[Column, Column]:
    """Address and number of result pages of an engine that is read in the general way; null if it isn't known."""
    host = F.lit("www.google.com")
    for end, name in GOOGLE_HOSTS.items():
        host = F.when(engine.endswith(end), name).otherwise(host)
    found = F.lit(None).cast("struct<address:string,pages:int>")
    for begin, part, address, pages in reversed(TEMPLATES):
        wanted = (engine == begin) if begin == "info" else engine.startswith(begin) & engine.contains(part)
        found = F.when(wanted, F.struct(F.lit(address).alias("address"), F.lit(pages).alias("pages"))).otherwise(found)
    once = let(found, lambda f: F.struct(F.replace(f["address"], F.lit("{host}"), host).alias("address"), f["pages"].alias("pages")))
    return once["address"], once["pages"]


def asked_at(engine: Column) -> Column:
    """Struct (address, form, pages, first, step) of an engine, its own or the general one; null fields if it isn't known."""
    address, pages = template(engine)
    shape = "struct<address:string,form:string,pages:int,first:int,step:int>"
    out = F.struct(address.alias("address"), F.lit(None).cast("string").alias("form"), pages.alias("pages"), F.lit(0).alias("first"), F.lit(10).alias("step")).cast(shape)
    for name, values in OWN.items():
        out = F.when(engine == name, F.struct(*map(F.lit, values)).cast(shape)).otherwise(out)
    return out


def requests(queries: DataFrame, engines: DataFrame) -> DataFrame:
    """(query_id, name, engine, page, address, form): a row for each result page of each known engine. ``engines`` is a short list.

    Names that stand for one engine ask it once each. A form is what is sent; the first page of a form that has an offset is sent without it.
    """
    known = engines.select(F.col("engine").alias("name"), implementation(F.col("engine")).alias("engine")).select("name", "engine", let(F.col("engine"), asked_at).alias("at")).where("at.address is not null")
    asked = queries.join(F.broadcast(known), F.lit(True)).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("at.pages"))))
    text = F.replace(F.url_encode(F.trim("query")), F.lit("+"), F.lit("%20"))
    offset = F.col("at.first") + (F.col("page") - 1) * F.col("at.step")

    def filled(shape: Column) -> Column:
        for mark, value in (("{query}", text), ("{offset}", offset.cast("string")), ("{next}", (offset + 1).cast("string")), ("{page}", F.col("page").cast("string"))):
            shape = F.replace(shape, F.lit(mark), value)
        return shape

    form = F.when((F.col("page") == 1) & F.col("at.form").contains("{offset}"), F.regexp_replace("at.form", r"&s=.*$", "")).otherwise(F.col("at.form"))
    return asked.select("query_id", "name", "engine", "page", filled(F.col("at.address")).alias("address"), filled(form).alias("form"))


def opensearch(answer: Column) -> Column:
    """Array of (url, title, snippet, rank) from a JSON list [query, titles, snippets, links], as long as the shortest."""
    part = lambda k: F.from_json(F.get_json_object(answer, f"$[{k}]"), "array<string>")
    n = F.least(F.size(part(1)), F.size(part(2)), F.size(part(3)))
    rows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.trim(F.get(part(3), i - 1)).alias("url"), F.trim(F.get(part(1), i - 1)).alias("title"), F.trim(F.get(part(2), i - 1)).alias("snippet")))
    return _ranked(F.when(n > 0, rows))


def wiby(answer: Column) -> Column:
    """The same from {"Results": [{"URL", "Title", "Snippet"}]}."""
    parsed = F.from_json(answer, "Results array<struct<URL:string,Title:string,Snippet:string>>")["Results"]
    return _ranked(F.transform(parsed, lambda r: F.struct(F.trim(r["URL"]).alias("url"), F.trim(r["Title"]).alias("title"), F.coalesce(F.trim(r["Snippet"]), F.lit("")).alias("snippet"))))


def _ranked(rows: Column) -> Column:
    kept = F.filter(rows, lambda r: (F.coalesce(r["url"], F.lit("")) != "") & (F.coalesce(r["title"], F.lit("")) != ""))
    return F.transform(kept, lambda r, i: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["snippet"].alias("snippet"), (i + 1).alias("rank_position")))


GOLDEN = "version string, queries array<struct<query:string,expected_intent:string,expected_mode:string,relevance_judgments:map<string,string>,expected_keywords:array<string>>>"
# Grades by name.
GRADES = {"NotRelevant": 0, "Marginal": 1, "Relevant": 2, "Perfect": 3}


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_intent, expected_mode, url, grade) of a file of judged queries; a query without judgments has none."""
    rows = spark.read.schema(GOLDEN).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")
    return judgments(rows).select("query", "expected_intent", "expected_mode", "url", "grade")


def judgments(rows: DataFrame) -> DataFrame:
    """A row (url, grade) for each of the relevance judgments, a map from address to the grade's name."""
    grade = F.create_map(*(F.lit(x) for kv in GRADES.items() for x in kv))
    return rows.select("*", F.explode("relevance_judgments").alias("url", "name")).withColumn("grade", F.try_element_at(grade, F.col("name")))


HISTORY = "id string, query string, focus_mode string, answer string, sources_count bigint, sources_found bigint, elapsed_secs double, timestamp string"


#: When an entry was appended, and its place among those appended with it.
ARRIVAL = "appended bigint, place bigint"


def append_history(entries: DataFrame, path: str) -> None:
    """Append entries, which arrive in the order of their rows."""
    named = entries.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in HISTORY.split(", ")))
    named.withColumns({"appended": F.unix_micros(F.current_timestamp()), "place": F.monotonically_increasing_id()}).write.mode("append").json(path)


def history(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Past searches, those appended last first; lines that can't be read are left out, and no folder is an empty history.

    Lines without a mark of their arrival come last, by their timestamp.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], HISTORY)
    lines = spark.read.schema(f"{HISTORY}, {ARRIVAL}").json(path, mode="DROPMALFORMED")
    rows = lines.orderBy(*(F.desc_nulls_last(c) for c in ("appended", "place", "timestamp", "id"))).drop("appended", "place")
    return rows if newest is None else rows.limit(newest)


def history_count(spark: SparkSession, path: str) -> int:
    return history(spark, path).count()


def clear_history(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def server_events(lines: DataFrame) -> DataFrame:
    """(stream, ord, data) of lines (stream, ord, line) of a server-sent stream, up to [DONE]."""
    said = lines.withColumn("data", F.trim(F.regexp_extract(F.regexp_replace("line", "\r$", ""), "^data:(.*)$", 1))).where(F.col("line").startswith("data:"))
    ended = F.max((F.col("data") == "[DONE]").cast("int")).over(Window.partitionBy("stream").orderBy("ord"))
    return said.withColumn("ended", ended).where("ended = 0").select("stream", "ord", "data")


def error_message(answer: Column) -> Column:
    """What a JSON answer says went wrong, by the places where services put it; else its first 300 characters."""
    at = lambda path: F.get_json_object(answer, path)
    flat = F.when(~at("$.error").rlike(r"^\s*[\[{]"), at("$.error"))
    return F.coalesce(at("$.error.message"), flat, at("$.error.error.message"), at("$.message"), at("$.detail"), F.when(F.length(answer) > 300, F.concat(F.substring(answer, 1, 300), F.lit("..."))).otherwise(answer))


def spoken(text: Column) -> Column:
    """An answer as it can be read aloud: no marks, no numeric references, one space between words."""
    plain = text
    for mark, instead in (("**", ""), ("##", ""), ("`", ""), ("\n\n", ". "), ("\n", " ")):
        plain = F.replace(plain, F.lit(mark), F.lit(instead))
    plain = F.regexp_replace(F.regexp_replace(F.substring(plain, 1, 5000), r"\[[0-9, ]*\]", ""), r"\[([^\]]*)\]?", "$1")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def video_description(html: Column) -> Column:
    """The short description that a video page carries as JSON; null if there is none."""
    raw = F.regexp_extract(html, r'"shortDescription":"((?:\\.|[^"\\])*)"', 1)
    for mark, instead in (("\\n", " "), ('\\"', '"'), ("\\u0026", "&"), ("\\/", "/")):
        raw = F.replace(raw, F.lit(mark), F.lit(instead))
    return F.nullif(F.trim(raw), F.lit(""))


def proxies(lines: DataFrame) -> DataFrame:
    """(n, proxy) from (kind, ord, line): a 'list' with commas, the lines of a 'file' without comments, then 'ports' of this machine; each once, where it came first."""
    parts = F.transform(F.split("line", ","), lambda p: F.trim(p))
    local = F.transform(F.filter(parts, lambda p: p.rlike("^[0-9]+$")), lambda p: F.concat(F.lit("socks5h://127.0.0.1:"), p))
    each = F.when(F.col("kind") == "list", parts).when(F.col("kind") == "file", F.filter(F.array(F.trim("line")), lambda p: ~p.startswith("#"))).when(F.col("kind") == "ports", local)
    order = F.when(F.col("kind") == "list", 0).when(F.col("kind") == "file", 1).otherwise(2)
    rows = lines.select(order.alias("k"), "ord", F.posexplode(F.filter(each, lambda p: p != "")).alias("i", "proxy"))
    first = rows.groupBy("proxy").agg(F.min(F.struct("k", "ord", "i")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("n"), "proxy")  # a short list of settings


def dealt(requests: DataFrame, pool: DataFrame, seq: str = "seq") -> DataFrame:
    """Requests, numbered from 0 in ``seq``, each with the proxy whose turn it is; null without any."""
    size = pool.agg(F.count("*").alias("of"))
    turns = requests.join(F.broadcast(size), F.lit(True)).withColumn("n", F.when(F.col("of") > 0, F.pmod(F.col(seq), F.col("of"))).cast("int"))
    return turns.join(F.broadcast(pool), "n", "left").drop("n", "of")


def models(answer: Column) -> Column:
    """Sorted names in a service's list of models: ids of 'data', or if there are none names of 'models' that can generate, without their folder."""
    ids = F.from_json(F.get_json_object(answer, "$.data"), "array<struct<id:string>>")
    named = F.from_json(F.get_json_object(answer, "$.models"), "array<struct<name:string,supportedGenerationMethods:array<string>>>")
    able = F.filter(named, lambda m: m["supportedGenerationMethods"].isNull() | F.array_contains(m["supportedGenerationMethods"], "generateContent"))
    clean = lambda names: F.filter(F.transform(names, lambda m: F.regexp_replace(F.trim(m), "^models/", "")), lambda m: F.coalesce(m, F.lit("")) != "")
    first = clean(F.transform(ids, lambda m: m["id"]))
    return F.array_sort(F.when(F.size(first) > 0, first).otherwise(F.coalesce(clean(F.transform(able, lambda m: m["name"])), F.array().cast("array<string>"))))


def asked_of(queries: DataFrame, mode: str = "mode") -> DataFrame:
    """``queries`` with a row for each engine of the set that its mode names (ord, engine, weight).

    The set "all" is the primary engines and then the backup ones, with nothing
    removed; a mode that isn't known, or is null, asks the default set.
    """
    sets = ENGINE_SETS | {"all": ENGINE_SETS["primary"] + ENGINE_SETS["backup"]}
    listed = F.array(*map(F.lit, sets["default"]))
    for name, names in sets.items():
        listed = F.when(F.col(mode) == name, F.array(*map(F.lit, names))).otherwise(listed)
    return queries.select("*", F.posexplode(listed).alias("ord", "engine")).withColumn("weight", fusion.weight(F.col("engine")))
