"""Spelling variants against a plain comparison of all pairs."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    forms = {}
    for w, n in counts.items():
        found = [(-m, o) for o, m in counts.items() if near(w, o)]
        best = min(found, default=None)
        forms[w] = (best[1] if best and -best[0] >= 5 * n else None, len(found), -best[0] if best and -best[0] >= 5 * n else None)
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.add((w, forms[w][0], root, n, forms[w][1], forms[w][2]))
    return out


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


TEXT = "receive receive recieve Ärger ÄRGER×x naïveté occurrence ocurrence occurence colour-colours colouring"
ROWS = [(i, TEXT + " separate" * (i % 5) + " seperate" * (i % 2)) for i in range(900)]
ROWS += [(2000, None), (2001, ""), (None, "receive recieve"), (2002, "a" * 50_000), *[(2003, "abcdef " * 40 + "abcdeg " * 6 + "abcdfg " * 6)] * 2]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("word", "run", "h", "key", "n", "other", "form", "root")})


def test_group_is_the_plain_one(docs):
    want = plain(counted(ROWS))
    assert {tuple(r) for r in spelling.group(docs).collect()} == want
    assert any(r[1] for r in want) and len(want) >= 15


def test_chains_ties_and_near_pairs(spark):
    counts = {"aaaaaa": 5, "aaaaab": 30, "aaaabb": 200, "aaabbb": 1500, "aabbbb": 9000, "abcabc": 7, "abcabd": 7, "abcabca": 35, "abcabcb": 35, "bcabca": 6, "zzzzzz": 8, "zzzzzzz": 39, "ababab": 10, "bababa": 10, "ßßßßßß": 50, "ßßßßßé": 5, "𐐀ßßßßß": 5}
    words = spark.createDataFrame([*counts.items()], "word string, n bigint")
    got = {tuple(r) for r in spelling.variants(words).collect()}
    assert got == plain(counts)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "aabbbb" and {r[0]: r[1] for r in got}["abcabc"] == "abcabca"


def test_many_words_against_all_pairs(spark):
    import random

    rng = random.Random(9)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(6, 9))): int(rng.paretovariate(0.5)) + 4 for _ in range(700)}
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame([*counts.items()], "word string, n bigint")).collect()}
    assert got == plain(counts)


def test_each_deletion_once(spark):
    rows = spelling.emitted(spark.createDataFrame([("aabbcc", 5), ("abcdef", 5)], "word string, n bigint")).groupBy("word").count().collect()
    assert {r["word"]: r["count"] for r in rows} == {"aabbcc": 4, "abcdef": 7}


def test_tables_without_words(docs):
    assert spelling.group(docs.where("false")).collect() == []
    assert spelling.group(docs.where("doc_id in (2000, 2001)")).collect() == []
