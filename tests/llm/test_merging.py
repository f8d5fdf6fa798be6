"""The merge of two branches against a plain one in Python, and its SQL twin."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import merging, queries

ROWS = [(i, "\n".join(f"line {k} of {i}" for k in range(i % 9)), None if i % 5 == 0 else "en", "" if i % 7 == 0 else f"s{i % 3}") for i in range(400)]
ROWS += [(1000, None, None, None), (1001, "", "fr", "a"), (1002, "\n\n", "fr", "a"), (1003, "x\r\ny é\n" * 300, "fr", "a"), (None, "no id\nat all", "en", "a")]
MARK = {1: "!", 2: "?", 3: "!", 4: "?"}


def plain(rows):
    """{doc_id: (lang, source, text, clean, edit-edit, edit-delete, insert-insert)}."""

    def code(branch, doc_id, name):
        return 99 if doc_id is None else zlib.crc32(f"{branch}:{doc_id}:{name}".encode()) % 17

    out, extra = {}, {"L": {}, "R": {}}
    for doc_id, *values in rows:
        text, lang, source = (v or "" for v in values)
        lines = text.split("\n")
        drops = {b: code(b, doc_id, "row") == 0 for b in "LR"}
        for b, down in (("L", -1), ("R", -5)):
            if code(b, doc_id, "row") in (3, 4):
                extra[b][down - doc_id] = (lang, source, MARK[code(b, doc_id, "row")])
        state = {}
        for b in "LR":
            changes = {}
            for name, value in (("lang", lang), ("source", source)):
                c = code(b, doc_id, name)
                new = "" if c == 0 else value + MARK[c] if c in (1, 2) else value
                if new != value:
                    changes[name] = new
            for i, line in enumerate(lines):
                c = code(b, doc_id, i)
                if c <= 2:
                    changes[i] = None if c == 0 else line + MARK[c]
                elif c <= 4:
                    changes["gap", i] = MARK[c]
            state[b] = changes
        counts = [0, 0, 0, 0]
        used = {**state["R"], **state["L"]}
        if drops["L"] or drops["R"]:
            other = "R" if drops["L"] else "L"
            counts[2 if not drops[other] and state[other] else 0] = 1
            if drops["L"] or not state["L"]:
                out[doc_id] = (None, None, None, *counts)
                continue
            used = state["L"]
        else:
            for unit in {**state["L"], **state["R"]}:
                one, two = (state[b].get(unit, "none") for b in "LR")
                if unit not in state["L"] or unit not in state["R"] or one == two:
                    counts[0] += 1
                else:
                    counts[3 if isinstance(unit, tuple) else 2 if None in (one, two) else 1] += 1
        merged = []
        for i, line in enumerate(lines):
            merged += [x for x in (used.get(i, line), used.get(("gap", i))) if x is not None]
        out[doc_id] = (used.get("lang", lang), used.get("source", source), "\n".join(merged), *counts)
    for doc_id in {**extra["L"], **extra["R"]}:
        one, two = extra["L"].get(doc_id), extra["R"].get(doc_id)
        differ = one is not None and two is not None and one != two
        out[doc_id] = (*(one or two), int(not differ), 0, 0, int(differ))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("part", "at", "value", "version", "gone", "l", "r", "n_clean", "changes")})


def test_merge_is_the_plain_one(docs):
    want = plain(ROWS)
    got = {r.doc_id: tuple(r)[1:] for r in merging.drawn(docs).collect()}
    assert got == want
    assert sum(v[6] for v in want.values()) and sum(v[5] for v in want.values()) and any(v[0] is None for v in want.values())


def test_digest(docs):
    want = plain(ROWS)
    for r in merging.digest(docs).collect():
        text = want[r.doc_id][2]
        assert r.text_sha256 == (None if text is None else hashlib.sha256(text.encode()).hexdigest())


def test_repeated_rows_are_merged_each(docs):
    once = merging.drawn(docs.where("doc_id < 50")).where("doc_id >= 0").collect()
    twice = merging.drawn(docs.where("doc_id < 50").union(docs.where("doc_id < 50"))).where("doc_id >= 0").collect()
    assert sorted(map(str, twice)) == sorted(map(str, once + once))


def test_empty_table(docs):
    assert merging.digest(docs.where("false")).collect() == []


def test_logs_hold_changes_only(docs):
    base = merging.base_of(docs)
    log = merging.drawn_log(base, "L")
    assert log.where("part = 3 and value is not null").join(base, ["doc_id", "version"]).where("value = split(text, '\\n')[at]").isEmpty()
    n = base.selectExpr("sum(size(split(text, '\\n', -1)))").first()[0]
    assert 0.2 * n < log.where("part >= 3").count() < 0.4 * n


def test_given_logs(spark):
    base = merging.base_of(spark.createDataFrame([(1, "a\nb\nc", "en", "s"), (2, "x", "en", "s")], "doc_id bigint, text string, lang string, source string"))
    keyed = {r.doc_id: r.version for r in base.collect()}
    log = lambda rows: spark.createDataFrame([(d, keyed[d], p, at, v) for d, p, at, v in rows], "doc_id bigint, version bigint, part int, at int, value string")
    left = log([(1, merging.LINE, 0, "A"), (1, merging.LINE, 1, None), (2, merging.ROW, 0, None)])
    right = log([(1, merging.LINE, 0, "Z"), (1, merging.LINE, 1, "B"), (1, merging.GAP, 2, "d"), (2, merging.LANG, 0, "fr")])
    no = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: tuple(r)[1:] for r in merging.merge(base, (left, right), (no, no)).collect()}
    assert got == {1: ("en", "s", "A\nc\nd", 1, 1, 1, 0), 2: (None, None, None, 0, 0, 1, 0)}


@pytest.mark.parametrize("name", ["op11_merge", "op13_spelling"])
def test_sql_twin(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.queries()[name](spark, sf)
    order = sorted(got.columns)
    want = con.execute(f"select {', '.join(order)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want))
