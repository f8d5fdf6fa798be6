"""Column functions and operators of the retrieval library on literal cases."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestar.functions import intent, text, urls
from lodestar.operators import context, evaluation, fusion, ranking, responses


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("out")).collect()
    return [r["out"] for r in sorted(rows)]


def test_normalized(spark):
    cases = {
        " HTTP://Example.COM:80/a/../b/./c?utm_source=x&q=1#frag ": "http://example.com/b/c?q=1",
        "https://x.org": "https://x.org/",
        "https://x.org:8443/p/?REF=1&a=b%26c&flag": "https://x.org:8443/p/?a=b&c&flag=",
        "ftp://x.org/a": None,
        "": None,
        None: None,
        "https://x.org/a/..": "https://x.org/",
        "https://x.org/a?q=one+two": "https://x.org/a?q=one two",
    }
    assert apply(spark, urls.normalized, list(cases)) == list(cases.values())


def test_skips_and_keys(spark):
    assert apply(spark, urls.skipped, ["https://docs.nginx.com/a", "https://x.org/file.ZIP", "https://x.org/a", "https://play.google.com/"]) == [True, True, False, True]
    assert apply(spark, urls.dedup_key, ["https://X.org/A//?q=B", "http://x.org/a?q=B", "not a url"]) == ["x.org/a?q=B", "x.org/a?q=B", "not a url"]
    assert apply(spark, lambda u: urls.focus_bypass(u, F.lit("reddit")), ["https://www.reddit.com/r", "https://x.org"]) == [True, False]
    assert apply(spark, urls.old_reddit, ["https://www.reddit.com/r", "https://old.reddit.com/r"]) == ["https://old.reddit.com/r", "https://old.reddit.com/r"]


def test_redirects(spark):
    cases = {
        "/l/?uddg=https%3A%2F%2Fa.org%2F%3Fx%3D1&rut=2": "https://a.org/?x=1", "/url?q=https%3A%2F%2Fa.org&sa=U": "https://a.org", "//a.org/p": "https://a.org/p", "https://a.org": "https://a.org", "/local": None,
        "https://a.org/p?uddg=https%3A%2F%2Fb.org": "https://a.org/p?uddg=https%3A%2F%2Fb.org", "//d.example/l/?uddg=https%3A%2F%2Fa.org": "https://d.example/l/?uddg=https%3A%2F%2Fa.org",
        "/url?sa=t&url=https%3A%2F%2Fu.org&q=https%3A%2F%2Fq.org": "https://u.org", "/url?q=https%3A%2F%2Fq.org%2Fa+b&url=https%3A%2F%2Fu.org": "https://q.org/a b",
    }
    assert apply(spark, urls.redirect_target, list(cases)) == list(cases.values())


def test_labels(spark):
    tags = apply(spark, urls.credibility, ["https://cs.stanford.edu/", "https://en.wikipedia.org/x", "https://www.reddit.com/", "https://docs.python.org", "https://www.a.org", "nothing"])
    assert tags == ["[High Trust - Institutional]", "[High Trust - Wikipedia]", "[Forum Discussion - Reddit]", "[High Trust - Docs - Python Docs]", "[General Web - a.org]", "[General Web - unknown]"]
    assert [round(x, 2) for x in apply(spark, urls.trust, ["https://a.gov", "https://github.com/x", "https://www.bbc.com", "https://wired.com", "https://quora.com", "https://a.org"])] == [1.5, 1.3, 1.2, 1.1, 0.8, 1.0]


def test_intent(spark):
    cases = {
        "github login": "navigational", "spotify": "navigational", "python vs rust": "comparison", "which is better a or b": "comparison", "who is ada lovelace": "person", "how to boil eggs": "howto",
        "latest iphone": "temporal", "ceo of acme": "temporal", "explain gravity": "research", "one two three four five six seven eight": "research", "capital france": "factual", "amazon order tracking": "factual", "": "factual",
    }
    assert apply(spark, intent.intent, list(cases)) == list(cases.values())
    hints = {"do you know it": "now", "isaac newton": "new", "justice league": "just", "gdp 2024": "2024", "stock price x": "current", "events last week": "last week", "boil eggs": None}
    assert apply(spark, intent.temporal_hint, list(hints)) == list(hints.values())
    assert apply(spark, lambda q: intent.with_year(q, "2026"), ["latest news", "latest news 2025", "boil eggs"]) == ["latest news 2026", "latest news 2025", "boil eggs"]


def test_entities(spark):
    got = apply(spark, intent.entities, ["What did Ada Lovelace tell Charles Babbage - in London? Ada Lovelace", "none here", "", "(Paris) - Berlin"])
    assert got == [["Ada Lovelace", "Charles Babbage", "London Ada Lovelace"], [], [], ["Paris Berlin"]]


def test_caps(spark):
    rows = spark.createDataFrame([("fast", 500, "factual", "medium"), (None, 10, "factual", "complex"), ("auto", None, "navigational", "simple"), ("specialized_tech", None, "factual", "medium"), ("research", 5000, "factual", "medium")], "f string, m int, k string, g string")
    got = [r[0] for r in rows.select(intent.url_cap(F.col("f"), F.col("m"), 100, F.col("k"), F.col("g"))).collect()]
    assert got == [30, 100, 30, 100, 900]


def sentences(body):
    """The rule of sentence_chunks, a character at a time."""
    out, now, i = [], "", 0
    while i < len(body):
        now += body[i]
        if body[i] in ".!?" and i + 2 < len(body) and body[i + 1] == " " and body[i + 2].isupper() and len(now) >= 80:
            out.append(now.strip())
            now, i = "", i + 2
            continue
        i += 1
    if now.strip():
        if len(now) < 80 and out:
            out[-1] += " " + now.strip()
        else:
            out.append(now.strip())
    return out or [body]


def test_sentence_chunks(spark):
    import random

    rng = random.Random(0)
    bodies = [" ".join(rng.choice(["word", "Word.", "A.", "end!", "Étude?", "x"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    assert apply(spark, text.sentence_chunks, bodies) == [sentences(b) for b in bodies]


def test_paragraphs_and_overlap(spark):
    assert apply(spark, text.paragraphs, ["a\r\n\r\nb", "", "\n\n \n\n", "x" * 90 + "\n\n" + "y" * 600, "x" * 70 + "\n\n" + "y" * 600]) == [["a\n\nb"], [], [], ["x" * 90, "y" * 600], ["x" * 70 + "\n\n" + "y" * 600]]
    got = spark.range(1).select(text.overlapped(F.array(F.lit("one two three four five six " * 6), F.lit("next")))).first()[0]
    assert got[1].endswith("… next") and not got[1].startswith(" ")


def test_cleaned(spark):
    body = "Same   paragraph with words\n\nsame paragraph WITH words\n\nRead more about it\nkept line here\n\nab\n\nnull​ byte line"
    assert apply(spark, text.cleaned, [body]) == ["Same paragraph with words\n\nkept line here\n\nnull byte line"]


def test_quality(spark):
    assert apply(spark, text.quality, ["", "A sentence that is long enough to count here.\nshort", "a\nb\nc"]) == [0, 10, 0]


def test_tokens(spark):
    assert apply(spark, text.tokens, ["The Quick-brown é fox's 2nd x", ""]) == [["quick", "brown", "é", "fox", "2nd"], []]


def test_weights_are_floats(spark):
    got = apply(spark, fusion.weight, ["google", "yahoo", "wiby", "bing_news", "whatever"])
    assert got == [1.5, 1.2000000476837158, 0.800000011920929, 1.0, 1.0]


def test_mmr_passes_over_full_addresses_until_all_are():
    assert ranking.mmr_order([5, 4, 3, 2, 1], [frozenset([i]) for i in range(5)], ["u"] * 4 + ["v"], 5) == [0, 1, 2, 4, 3]
    same = frozenset("ab")
    assert ranking.mmr_order([1.0, 0.9, 0.5], [same, same, frozenset("c")], ["a", "b", "c"], 2) == [0, 2]


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("z", "a", 1)], "query_id string, item string, rank int")
    qrels = spark.createDataFrame([("q", "b", 3), ("q", "d", 1), ("z", "k", 0)], "query_id string, item string, grade int")
    got = {r["query_id"]: r for r in evaluation.ndcg(run, qrels).collect()}
    assert got["q"]["ndcg"] == pytest.approx((7 / 1.584962500721156) / (7 + 1 / 1.584962500721156)) and got["z"]["ndcg"] == 0
    assert {r["query_id"]: r["rr"] for r in evaluation.reciprocal_rank(run, qrels).collect()} == {"q": 0.5, "z": 0.0}
    assert {r["query_id"]: r["recall"] for r in evaluation.recall(run, qrels, 10).collect()} == {"q": 0.5, "z": 0.0}


def test_percentiles(spark):
    rows = [("a", 1.0), ("b", 1.0), ("b", 2.0), *(("c", float(i)) for i in range(1, 101))]
    got = {r["g"]: r for r in evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["a"]["p50"] == 1 and got["b"]["p50"] == 2 and got["c"]["p50"] == 51 and got["c"]["p95"] == 95 and got["c"]["mean"] == 50.5


def test_ordered_bits(spark):
    rng = random.Random(3)
    values = [0.0, 5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, math.inf]
    values += [f(2.0**e) for e in range(-1074, 1024) for f in (lambda v: v, lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, math.inf))]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(2000)]
    values = [v for v in values if v == v]
    values += [-v for v in values]
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(evaluation.ordered_bits(F.col("v")).alias("b")).collect()]
    bits = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert got == [bits(v) for v in values]


def test_percentiles_are_exact(spark):
    """Against sorting: ties, neighbouring doubles, signs, NaN, nulls, empty groups and clashing names."""
    rng = random.Random(5)
    close = 1.0
    rows = [(None, 3.0), ("nulls", None)]
    for _ in range(300):
        close = math.nextafter(close, 2)
        rows += [("close", close), ("signs", rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300)), ("ties", float(rng.randint(0, 3))), ("odd", rng.choice([0.0, -0.0, math.inf, -math.inf, math.nan, 2.5]))]
    data = spark.createDataFrame([(g, v, g, 1.0) for g, v in rows], "n string, p50 double, g string, at double")
    for few in (evaluation.MANY_GROUPS, 1):
        evaluation.MANY_GROUPS, kept = few, evaluation.MANY_GROUPS
        try:
            found = evaluation.percentiles(data.withColumnRenamed("n", "by"), "by", "p50", (0, 50, 95, 99, 100)).collect()
        finally:
            evaluation.MANY_GROUPS = kept
        got = {r["by"]: r for r in found}
        assert set(got) == {None, "close", "signs", "ties", "odd"}
        for group, r in got.items():
            own = sorted((v for g, v in rows if g == group and v is not None), key=lambda v: (v != v, v))
            assert r["n"] == len(own)
            for p in (0, 50, 95, 99, 100):
                want = own[math.floor(p / 100 * (len(own) - 1) + 0.5)]
                assert r[f"p{p}"] == want or (want != want and r[f"p{p}"] != r[f"p{p}"]), (group, p)
    assert evaluation.percentiles(data.limit(0), "n", "p50").collect() == []


def test_whole_report_without_engines(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    row = evaluation.whole_report(one, one.withColumnRenamed("x", "p"), evaluation.health(spark.createDataFrame([], "engine string, event_type string"), "engine"), one.withColumnRenamed("x", "r"), one.withColumnRenamed("x", "c"), F.lit(5), "2").first()
    assert row["engine_health"] == {} and (row["generated_at"], row["version"], row["p"]) == (5, "2", 1.0)


def test_context(spark):
    ranks = spark.range(1, 7).select("id", context.sandwich(F.col("id"), F.lit(6)).alias("p")).orderBy("p").collect()
    assert [r["id"] for r in ranks] == [1, 3, 5, 6, 4, 2]
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate([10, 10, 100, 1], 1)], "g string, place int, s int")
    assert [r["place"] for r in context.within_budget(rows, "g", "place", F.col("s"), 50).collect()] == [1, 2]


def test_answers(spark):
    cases = {"<think>x</think>  Answer": "Answer", "A<THINK>never closed": "A", "Here is a summary:\nThe text": "The text", "Here is a summary": "Here is a summary", " plain ": "plain"}
    assert apply(spark, context.processed, list(cases)) == list(cases.values())
    assert apply(spark, context.insufficient, ["short", "x" * 100, "x" * 300, "x" * 300 + "[2]"]) == [True, False, True, False]


def test_citations(spark):
    answers = spark.createDataFrame([("k", "Alpha beta gamma holds [1]. Something unrelated entirely [2]. Out of range [9].")], "key string, answer string")
    sources = spark.createDataFrame([("k", 1, "alpha", "beta gamma holds"), ("k", 2, "zzz", "yyy")], "key string, n int, title string, text string")
    assert {(r["n"], r["flagged"]) for r in context.citations(answers, sources, "key").collect()} == {(1, False), (2, True)}


def test_mmr_looks_behind_copies(spark):
    rng = random.Random(2)
    rows = [(1, i, float(1000 - i), "one and the same text of a copy", f"u{i}") for i in range(1, 251)] + [(1, i, 1000.0 - i, f"other words {i}", f"v{i // 4}") for i in range(251, 300)]
    rows += [(2, i, 1.0, " ".join(rng.choices("abcdefgh", k=5)), f"u{i % 3}") for i in range(1, 60)]
    rows += [(3, i, 9.0 - i / 100, f"text {i}", "u" if i <= 150 else f"v{i}") for i in range(1, 200)]
    ranked = spark.createDataFrame([(q, i, i, *r) for q, i, *r in rows], "query_id bigint, seq int, doc_id bigint, score double, text string, url string")
    got = ranking.diversified(ranked, 10, 20).collect()
    for q in (1, 2, 3):
        own = [r for r in rows if r[0] == q]
        sets = {r["seq"]: frozenset(r["t"]) for r in ranked.where(F.col("query_id") == q).select("seq", text.tokens(F.col("text")).alias("t")).collect()}
        want = ranking.mmr_order([r[2] for r in own], [sets[r[1]] for r in own], [r[4] for r in own], 10)
        assert [r["seq"] for r in sorted(got, key=lambda r: r["mmr_rank"]) if r["query_id"] == q] == [i + 1 for i in want]
    assert 251 in {r["seq"] for r in got if r["query_id"] == 1}


def test_texts_without_a_boundary_take_linear_time(spark):
    body = "word " * 60_000
    assert apply(spark, text.sentence_chunks, [body.strip()]) == [[body.strip()]]
    many = "A short one. " * 20_000
    got = apply(spark, text.sentence_chunks, [many.strip()])[0]
    assert " ".join(got) == many.strip() and all(80 <= len(c) < 170 for c in got)


def test_many_paragraphs(spark):
    body = "\n\n".join(f"Paragraph number {i % 500} of a long text" for i in range(5000))
    assert apply(spark, text.cleaned, [body]) == ["\n\n".join(f"Paragraph number {i} of a long text" for i in range(500))]


def test_variations_and_live_rules(spark):
    rows = spark.createDataFrame([(" q ", "tech"), ("q", "other"), ("", "tech")], "q string, d string")
    assert [r[0] for r in rows.select(intent.domain_variations(F.col("q"), F.col("d"))).collect()] == [["q", "q programming tutorial"], ["q", "q guide"], []]
    assert apply(spark, lambda q: intent.with_year_live(q, "2026"), ["updated list", "who was it", "now 2023"]) == ["updated list 2026", "who was it", "now 2023"]


def test_lists_that_arent_ranked(spark):
    rng = random.Random(5)
    rows = [(q, i, rng.choice("abcd")) for q in ("x", "y", "z") for i in range(40)]
    qrels = [(q, i, rng.randrange(3)) for q in ("x", "y") for i in range(0, 40, 7)] + [("z", 3, 0)]
    scored = spark.createDataFrame(rows, "query_id string, item int, h string")
    judged = spark.createDataFrame(qrels, "query_id string, item int, grade int")
    ranked = fusion.top(scored, 100, "h", ("query_id",), ("item",))
    want = {r["query_id"]: r["rr"] for r in evaluation.reciprocal_rank(ranked, judged).collect()}
    assert {r["query_id"]: r["rr"] for r in evaluation.reciprocal_rank_of(scored, judged, "h").collect()} == want


def test_golden(spark):
    run = spark.createDataFrame([("Q One", "https://A.org/?utm_source=x", 1), ("Q One", "https://b.org/p#f", 2), ("q two", "https://a.org/", 1), ("unknown", "https://a.org/", 1)], "query string, url string, rank int")
    golden = spark.createDataFrame([(0, "q one", "https://b.org/p#f", 3), (1, "q one", "https://a.org/", 2), (1, "q one", "https://b.org/p#f", 1), (2, "q two", "https://c.org/", 3)], "ord int, query string, url string, grade int")
    named, qrels = evaluation.golden_qrels(run, golden)
    assert {tuple(r) for r in named.select("query", "item", "rank").collect()} == {("Q One", "https://a.org/", 1), ("Q One", "https://b.org/p#f", 2), ("q two", "https://a.org/", 1)}
    assert {tuple(r) for r in qrels.collect()} == {("q one", "https://a.org/", 2), ("q one", "https://b.org/p#f", 1), ("q two", "https://c.org/", 3)}
    one = evaluation.golden_report(run, golden).first()
    assert one["queries_evaluated"] == 3 and one["judged"] == 2 and one["mean_ndcg"] == pytest.approx(0.5) and one["mrr"] == 0.5 and one["mean_recall_10"] == 0.5


def test_hopeful_keeps_the_best(spark):
    rng = random.Random(1)
    rows = [(q, d, "the phrase", 10 * rng.random(), rng.random() / 50, ["alpha", "beta"], 0.02, rng.choice(["alpha x", "none", "alpha beta"]), rng.choice(["has the phrase in it", "has nothing"])) for q in range(4) for d in range(200)]
    scored = spark.createDataFrame(rows, "query_id int, doc_id int, phrase string, bm25 double, rrf double, terms array<string>, most double, title string, text string")
    full = fusion.top(ranking.with_bonuses(scored, "text", "title", "terms", "rrf", "most"), 7, "score", ("query_id",), ("doc_id",))
    some = ranking.hopeful(scored, 7, "terms", "rrf", "most")
    again = fusion.top(ranking.with_bonuses(some, "text", "title", "terms", "rrf", "most"), 7, "score", ("query_id",), ("doc_id",))
    assert some.count() < 600 and {tuple(r) for r in again.select("query_id", "doc_id", "rank").collect()} == {tuple(r) for r in full.select("query_id", "doc_id", "rank").collect()}


def test_passages(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "the of")], "query_id int, query string")
    long = "Alpha beta gamma delta is said here at some length so that it is a chunk of its own. "
    sources = spark.createDataFrame([(1, "https://A.org/?utm_source=x", "Alpha", long * 8), (2, "https://b.org/", "t", "alpha once"), (3, "https://c.org/", "t", ""), (4, "https://d.org/", "t", None)], "source_id int, url string, title string, text string")
    votes = spark.createDataFrame([("https://a.org/", 0.5)], "norm_url string, rrf double")
    got = ranking.Passages(queries, sources, votes).chosen(4, 2).collect()
    ones = sorted((r["mmr_rank"], r["chunk_id"]["source_id"]) for r in got if r["query_id"] == 1)
    assert ones[0][1] == 1 and {s for _, s in ones} == {1, 2} and sum(s == 1 for _, s in ones) == 3
    assert [(tuple(r["chunk_id"]), r["score"]) for r in sorted(got, key=lambda r: r["mmr_rank"]) if r["query_id"] == 2] == [((1, 0), None), ((1, 1), None), ((1, 2), None), ((1, 3), None)]


def test_carried_report_begins_with_a_whole_character(spark):
    bodies = ["short", "a" * 3001, "é" * 2000, "x" + "é" * 2000, "\U0001f600" * 1000, "xy" + "\U0001f600" * 1000]
    for body, got in zip(bodies, apply(spark, context.carried, bodies), strict=True):
        if len(body.encode()) <= 3000:
            assert got == body
        else:
            kept = got.removeprefix("[...truncated...] ")
            assert kept != got and body.endswith(kept) and 2997 <= len(kept.encode()) <= 3000
    rows = spark.createDataFrame([("longer", "short"), ("a", "bb"), ("[", "bb"), ("[1]", "b[1]")], "r string, f string")
    assert [r[0] for r in rows.select(context.better(F.col("r"), F.col("f"))).collect()] == ["longer", "bb", "[", "b[1]"]


def test_ranked_context_by_hand(spark):
    rows = [("q", "alpha beta", i, f"https://s{i}.org/", "alpha" if i == 3 else "t", text) for i, text in enumerate(["alpha", "nothing", "alpha beta", "alpha beta", "beta"])]
    sources = spark.createDataFrame(rows, "query_id string, query string, source_id int, url string, title string, text string")
    got = context.joined(context.ranked(sources)).first()["context"]
    assert got.split("\n\n")[:-1] == ["[1] [General Web - s3.org] alpha (https://s3.org/)\nalpha beta", "[2] [General Web - s0.org] t (https://s0.org/)\nalpha", "[3] [General Web - s4.org] t (https://s4.org/)\nbeta", "[4] [General Web - s2.org] t (https://s2.org/)\nalpha beta"]


def test_live_texts(spark):
    bodies = ["x" * 9, "x" * 110, "x" * 130, "é" * 2001, "xé" + "\U0001f600" * 1000]
    kept = apply(spark, lambda t: responses.live_text(t, F.lit("lite")), bodies)
    assert kept[:3] == [None, None, bodies[2]] and kept[3] == "é" * 2000 and kept[4] == "xé" + "\U0001f600" * 999
    assert apply(spark, lambda t: responses.live_text(t, F.lit("reddit")), ["x" * 9, "x" * 10]) == [None, "x" * 10]
    assert apply(spark, lambda t: responses.live_text(t, F.lit(None).cast("string")), ["x" * 49, "x" * 50]) == [None, "x" * 50]


def test_answers_without_results(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, "https://a.org/x", "google", 1), (1, "HTTPS://A.org/x/", "bing", 1), (1, "https://x.com/a", "bing", 2), (2, "https://x.com/a", "bing", 1)], "query_id int, url string, engine string, rank_position int")
    got = {r["query_id"]: r for r in responses.answers(queries, hits, [F.col("rank_position"), F.col("engine")], 2).collect()}
    assert (got[1]["status"], got[1]["total_raw"], got[1]["deduplicated"], got[1]["engines"]) == (200, 3, 1, ["bing", "google"]) and len(got[1]["results"]) == 2
    assert (got[2]["status"], got[2]["results"]) == (404, None) and got[3]["total_raw"] == 0 and got[3]["error"]
