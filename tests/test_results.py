"""Stored result pages as a data source, and lists that are filled up."""

from pyspark.sql import functions as F

from lodestar.operators import ranking
from lodestar.sources import results

PAGE = '<ul class="results-standard"><li><a class="title" href="https://{0}.example/">Title {0}</a><p class="s">Said {0}</p></li></ul>'


def stored(spark, folder):
    pages = [(i, e, p, PAGE.format(f"{e}{p}")) for i in (1, 2) for e in ("mojeek", "bing") for p in (1, 2, 3)] + [(3, "mojeek", 1, None), (4, "mojeek", 1, "<p>none</p>")]
    results.store(spark.createDataFrame(pages, "id bigint, engine string, page int, html string").repartition(2, "id"), folder)
    return results.hits(spark, folder)


def test_filters_decide_which_files_are_read(spark, tmp_path):
    hits = stored(spark, str(tmp_path / "s"))
    all_, one = hits.rdd.getNumPartitions(), hits.where("engine = 'mojeek' and page <= 2").rdd.getNumPartitions()
    assert one < all_ and hits.where("engine in ('bing')").rdd.getNumPartitions() < all_
    got = {(r.id, r.page, r.rank_position, r.url, r.title, r.snippet) for r in hits.where("engine = 'mojeek' and page <= 2 and id < 3").collect()}
    assert got == {(i, p, 1, f"https://mojeek{p}.example/", f"Title mojeek{p}", f"Said mojeek{p}") for i in (1, 2) for p in (1, 2)}


def test_every_filter_gives_what_a_plain_one_gives(spark, tmp_path):
    hits = stored(spark, str(tmp_path / "s"))
    rows = [tuple(r) for r in hits.collect()]
    for text, test in (("page > 1", lambda r: r[2] > 1), ("page >= 2 and page < 3", lambda r: r[2] == 2), ("engine = 'nobody'", lambda r: False), ("page <> 2", lambda r: r[2] != 2), ("title like '%1'", lambda r: r[5].endswith("1")), ("engine in ('bing', 'x') or page = 1", lambda r: r[1] == "bing" or r[2] == 1)):
        assert sorted(map(tuple, hits.where(text).collect())) == sorted(r for r in rows if test(r)), text


def test_no_folder_gives_no_rows(spark, tmp_path):
    assert results.hits(spark, str(tmp_path / "none")).collect() == []


def test_lists_are_filled_up_with_rows_without_a_score(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    scored = spark.createDataFrame([(1, 5), *((2, i) for i in range(6))], "query_id int, doc_id int")
    rows = spark.createDataFrame([(i, i // 2) for i in range(8)], "doc_id int, size int")
    got = ranking.zero_rows(asked, scored, rows, 3, [F.desc("size"), F.col("doc_id")], "doc_id").collect()
    assert sorted((r.query_id, r.seq, r.doc_id) for r in got) == [(1, 2, 6), (1, 3, 7), (3, 1, 6), (3, 2, 7), (3, 3, 4)]


def test_terms_inside_words_of_titles_are_found(spark):
    queries = spark.createDataFrame([(1, "art cat"), (2, "the of"), (3, "zebra")], "query_id int, query string")
    titled = spark.createDataFrame([(1, "An Article, it is"), (2, "c at"), (3, None), (4, "Concatenate art")], "id int, title string")
    got = ranking.title_hits(queries, titled, ["id"]).select("query_id", "id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 4)]


def test_passages_of_few_and_of_silent_queries(spark):
    sources = spark.createDataFrame([(1, "https://a.example", "t", "Zebra stripes here."), (2, "https://b.example", "t", ""), (3, "https://c.example", "t", "Other words stand here, and more of them."), (4, "https://d.example", "zebras", "Nothing else.")], "source_id int, url string, title string, text string")
    queries = spark.createDataFrame([(1, "zebra"), (2, "the of")], "query_id int, query string")
    votes = spark.createDataFrame([], "norm_url string, rrf double")
    got = {(r.query_id, r.mmr_rank): (r.chunk_id.source_id, r.score) for r in ranking.Passages(queries, sources, votes).chosen(3).collect()}
    assert [got[1, k][0] for k in (1, 2, 3)] == [1, 4, 3] and got[1, 3][1] == ranking.NOTHING
    assert [got[2, k] for k in (1, 2, 3)] == [(1, None), (3, None), (4, None)]
