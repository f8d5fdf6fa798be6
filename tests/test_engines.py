import json

from pyspark.sql import functions as F

from lodestar.sources import engines
from lodestar.streaming import state


def test_templates(spark):
    rows = spark.createDataFrame([(n,) for n in ("google_de", "google_news", "google_scholar", "bing", "brave_news", "info", "information", "wiby")], "engine string")
    address, pages = engines.template(F.col("engine"))
    got = {r["engine"]: (r["a"], r["p"]) for r in rows.select("engine", address.alias("a"), pages.alias("p")).collect()}
    assert got["google_de"] == ("https://www.google.de/search?q={query}&start={offset}", 3)
    assert got["google_news"][0].endswith("tbm=nws&start={offset}") and got["google_scholar"][0].startswith("https://scholar.")
    assert got["info"][1] == 2 and got["information"] == (None, None) and got["wiby"] == (None, None)
    asked = engines.requests(spark.createDataFrame([(1, " a b&c ")], "query_id int, query string"), rows.where("engine = 'google_de'")).collect()
    assert [r["address"] for r in asked] == [f"https://www.google.de/search?q=a%20b%26c&start={k}" for k in (0, 10, 20)]


def test_own_addresses(spark):
    rows = spark.createDataFrame([("yahoo_news",), ("duckduckgo_html",), ("startpage",), ("wikipedia",), ("unknown",)], "engine string")
    asked = engines.requests(spark.createDataFrame([(1, "a b")], "query_id int, query string"), rows).collect()
    by = {}
    for r in sorted(asked, key=lambda r: r["page"]):
        by.setdefault((r["name"], r["engine"]), []).append((r["address"], r["form"]))
    assert by["yahoo_news", "yahoo"] == [(f"https://search.yahoo.com/search?p=a%20b&n=20&b={k}", None) for k in (1, 11, 21, 31, 41)]
    assert by["duckduckgo_html", "duckduckgo"] == [("https://lite.duckduckgo.com/lite/", "q=a%20b"), ("https://lite.duckduckgo.com/lite/", "q=a%20b&s=20&dc=21")]
    assert by["startpage", "startpage"][4] == ("https://www.startpage.com/sp/search", "query=a%20b&cat=web&language=english&page=5")
    assert len(by["wikipedia", "wikipedia"]) == 1 and ("unknown", "unknown") not in by


def test_proxies(spark):
    lines = spark.createDataFrame([("ports", 0, "1x, 9050"), ("file", 2, "b"), ("file", 1, "#c"), ("list", 0, "a, b,,a")], "kind string, ord int, line string")
    pool = engines.proxies(lines)
    assert sorted(map(tuple, pool.collect())) == [(0, "a"), (1, "b"), (2, "socks5h://127.0.0.1:9050")]
    asked = spark.createDataFrame([(0,), (1,), (5,)], "seq int")
    assert [r["proxy"] for r in engines.dealt(asked, pool).orderBy("seq").collect()] == ["a", "b", "socks5h://127.0.0.1:9050"]
    assert [r["proxy"] for r in engines.dealt(asked, pool.where("false")).collect()] == [None] * 3


def test_enabled(spark):
    assert [r["engine"] for r in engines.enabled(spark, " Bing,, YAHOO ,").collect()] == ["bing", "yahoo"]


def test_json_answers(spark):
    rows = spark.createDataFrame([('["q",["A",""," C "],["s","t"],["u","v","w"]]', '{"Results":[{"URL":"u","Title":"T"},{"URL":"","Title":"x"}]}'), ("junk", "junk"), (None, None)], "a string, b string")
    got = rows.select(engines.opensearch(F.col("a")).alias("a"), engines.wiby(F.col("b")).alias("b")).collect()
    assert [tuple(x) for x in got[0]["a"]] == [("u", "A", "s", 1)] and [tuple(x) for x in got[0]["b"]] == [("u", "T", "", 1)]
    assert not got[1]["a"] and not got[1]["b"] and not got[2]["a"]


def test_golden(spark, tmp_path):
    judged = {"version": "1", "queries": [{"query": "q", "expected_intent": "factual", "expected_mode": "lite", "relevance_judgments": {"https://a.org": "Perfect", "https://b.org": "Odd"}, "expected_keywords": ["k"]}]}
    (tmp_path / "g.json").write_text(json.dumps(judged, indent=1))
    assert {(r["url"], r["grade"]) for r in engines.golden(spark, str(tmp_path / "g.json")).collect()} == {("https://a.org", 3), ("https://b.org", None)}


def test_history(spark, tmp_path):
    path = str(tmp_path / "h")
    for k in range(3):
        engines.append_history(spark.createDataFrame([(str(k), "q", None, "a", k, k, 0.5, f"2024-01-0{k + 1}")], engines.HISTORY), path)
    assert [r["id"] for r in engines.history(spark, path).collect()] == ["2", "1", "0"] and engines.history(spark, path, 1).count() == 1


def test_history_is_in_order_of_arrival(spark, tmp_path):
    path = str(tmp_path / "h")
    line = lambda i, at: (i, "q", None, "a", 1, 1, 0.5, at)
    engines.append_history(spark.createDataFrame([line("b", "2024-01-09"), line("a", "2024-01-08")], engines.HISTORY).coalesce(1), path)
    engines.append_history(spark.createDataFrame([line("c", "2024-01-01")], engines.HISTORY), path)
    spark.createDataFrame([line("old", "2025-01-01")], engines.HISTORY).write.mode("append").json(path)
    read = engines.history(spark, path)
    assert [r["id"] for r in read.collect()] == ["c", "a", "b", "old"] and len(read.columns) == 8


def test_history_is_counted_and_cleared(spark, tmp_path):
    path = str(tmp_path / "h")
    assert engines.history_count(spark, path) == 0
    engines.append_history(spark.createDataFrame([("1", "q", None, "a", 1, 1, 0.5, "2024-01-01")], engines.HISTORY), path)
    assert engines.history_count(spark, path) == 1
    engines.clear_history(spark, path)
    assert engines.history(spark, path).collect() == []


def test_server_events(spark):
    lines = ["event: x", "data: one\r", "", "data:two", "data: [DONE]", "data: late"]
    rows = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "stream string, ord int, line string")
    assert [r["data"] for r in engines.server_events(rows).orderBy("ord").collect()] == ["one", "two"]


def test_messages_and_speech(spark):
    cases = {'{"error":{"message":"a"}}': "a", '{"error":"b"}': "b", '{"error":{"error":{"message":"c"}}}': "c", '{"message":"d"}': "d", '{"detail":"e"}': "e", '{"x":1}': '{"x":1}'}
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    assert [r[0] for r in rows.select(engines.error_message(F.col("v"))).collect()] == list(cases.values())
    said = {"**Bold** [1] and [2, 3] but [kept]\n\nnext `code`": "Bold and but kept. next code", "### Head": "# Head"}
    rows = spark.createDataFrame([(k,) for k in said], "v string")
    assert [r[0] for r in rows.select(engines.spoken(F.col("v"))).collect()] == list(said.values())
    page = 'x "shortDescription":"say \\"hi\\"\\nand \\u0026 go" y'
    assert spark.createDataFrame([(page,), ("none",)], "v string").select(engines.video_description(F.col("v"))).collect() == [('say "hi" and & go',), (None,)]


def test_reports_keep_the_end(spark):
    turns = spark.createDataFrame([(1, 2, "b" * 10), (1, 1, "a" * 10), (1, 3, "c")], "key int, ord int, text string")
    assert state.reports(turns, 5).first()["report"] == "b" * 5 + "\nc"


def test_folds(spark):
    """Ties of ord, null texts and keys, a step that raises, an empty table, and keys that go over many Arrow batches."""
    rows = [("k", 1, "b"), ("k", 1, "a"), ("k", 0, None), (None, 1, "n"), ("bad", 1, "x"), ("bad", 2, "stop"), ("bad", 3, "y"), ("empty", 1, ""), ("empty", 2, "e")]
    rows += [("long", i, str(i % 10)) for i in range(500)]
    turns = spark.createDataFrame(rows, "key string, ord int, text string").repartition(3)

    def step(report, text):
        if text == "stop":
            raise ValueError(text)
        return report + text

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["key"]: tuple(r)[1:] for r in state.folded_reports(turns, step).collect()}
        tails = {r["key"]: r["report"] for r in state.reports(turns, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {"k": ("ab", 2, False), None: ("n", 1, False), "bad": ("x", 1, True), "empty": ("e", 2, False), "long": ("".join(str(i % 10) for i in range(500)), 500, False)}
    assert tails["long"] == "7\n8\n9"
    assert tails["k"] == "a\nb" and tails["empty"] == "e"
    assert state.folded_reports(turns.limit(0), step).collect() == []


def test_batches(spark):
    events = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 3, 9, 10])], "event_id bigint, user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["batch"], r["n"]) for r in state.count_or_timeout(events, 3, 5).orderBy("batch").collect()] == [(0, 3), (1, 1), (2, 2)]
