"""Language-model scores: exact counts and probabilities against plain ones, the filter's errors, both ways of asking it."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import lm

ROWS = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i % 17)) + " The\tEnd\x0bof é " * (i % 3)) for i in range(300)]
ROWS += [(1000, None), (1001, ""), (1002, " \n "), (1003, "long word " * 20000), (1003, "long word " * 20000), (None, "an id is missing"), (1004, "z" * 300_000 + " " + "never seen words")]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("score", "row_id", "n", "k", "lo", "raw", "segment", "block", "lang")})


def plain(order, mass):
    """Rows by exact counts."""
    counts = [Counter() for _ in range(order + 1)]
    for doc_id, text in ROWS:
        if not held(doc_id):
            t = tokens(text)
            counts[1].update((w,) for w in t)
            for k in range(2, order + 1):
                for i in range(len(t)):
                    before = [b"", *t][: i + 1][-(k - 1) :]
                    if len(before) == k - 1:
                        counts[k][*before, t[i]] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    out = []
    for doc_id, text in ROWS:
        t, score, base = tokens(text), 0.0, 0.0
        for i, w in enumerate(t):
            p = (counts[1][w,] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                before = [b"", *t][: i + 1][-(k - 1) :]
                if len(before) == k - 1:
                    c = counts[k - 1][tuple(before)]
                    p = (counts[k][*before, w] + mass * p) / (c + mass) if c else p
            score += math.log10(p)
        out.append((doc_id, held(doc_id), len(t), sum(counts[1][w,] > 0 for w in t), n, base, score))
    return out


def test_contract_columns_are_exact(docs):
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs).collect())
    want = sorted((r[0] or -1, *r[1:6]) for r in plain(2, 1.0))
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_near_those_of_exact_counts(docs, order):
    want = {r[0]: r for r in plain(order, lm.MASS)}
    for r in lm.score(docs, order=order).collect():
        assert r.score == pytest.approx(want[r.doc_id][6], abs=0.15 * order * r.n_tokens), r.doc_id  # counts are held to a factor of 1.5
        assert r.score <= 0


def test_broadcast_and_exchange_agree(docs):
    out = F.coalesce(lm.fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    for order in (2, 3):
        model = lm.fit(docs.where(~out), order)
        one, two = (sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.log_probabilities(model, docs, out, most).collect()) for most in (1 << 30, -1))
        assert [r[:3] for r in one] == [r[:3] for r in two] and np.allclose([r[3:] for r in one], [r[3:] for r in two], rtol=1e-9, atol=1e-6)


def test_exchange_writes_nothing_before_it_is_read(docs, monkeypatch):
    out = F.coalesce(lm.fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    model = lm.fit(docs.where(~out))

    def refused(df):
        raise AssertionError("questions and tokens were written first")

    monkeypatch.setattr(lm, "cut", refused)
    monkeypatch.setattr(lm, "ASKING", 1000)  # many slices a partition
    got = sorted((r.doc_id or -1, r.n_known, r.base_score) for r in lm.log_probabilities(model, docs, out, -1).collect())
    want = sorted((r[0] or -1, r[3], r[5]) for r in plain(2, 1.0))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-9, atol=1e-6)


def test_packed_numbers_are_small():
    rng = np.random.default_rng(4)
    for numbers, most in ((rng.zipf(1.5, 100_000).clip(1, 60_000).astype(np.uint32), 2.0), (np.sort(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)), 6.5), (np.zeros(0, np.uint64), 0)):
        packed = lm._packed(numbers)
        assert (lm._unpacked(packed) == numbers).all() and len(packed[2]) <= most * len(numbers) + 30


def test_rare_words_are_joined(docs, monkeypatch):
    out = F.coalesce(lm.fold_of(F.col("doc_id"), 7) == 2, F.lit(False))
    model = lm.fit(docs.where(~out))
    least = model.common(3)
    assert 0 < model.words(least=least).count() <= 3 and model.words().count() == model.n_words
    monkeypatch.setattr(lm.Model, "common", lambda self: least)
    got = sorted((r.doc_id or -1, r.n_known, r.base_score) for r in lm.log_probabilities(model, docs, out).collect())
    want = sorted((r[0] or -1, r[3], r[5]) for r in plain(2, 1.0))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-9, atol=1e-6)


def test_filter_never_reads_too_low_and_seldom_too_high():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) << np.uint64(1)
    counts = rng.zipf(1.7, len(keys)).clip(1, 10**9)
    of = lm._segment(keys, 4)
    parts = {s: lm.build(keys[of == s], counts[of == s]) for s in range(16)}
    held_ = lm.Filter(parts.items(), 4, sum(map(len, parts.values())))
    levels = held_.levels(keys)
    assert (levels >= lm.levels_of(counts)).all() and (levels > lm.levels_of(counts)).mean() < 0.02
    assert (held_.levels(keys | np.uint64(1)) > 0).mean() < 0.02
    bits = sum(map(len, parts.values())) * 8
    assert bits == pytest.approx(lm.levels_of(counts).sum() * lm.BITS, rel=0.01)


def test_levels_stand_for_their_counts():
    counts = np.arange(1, 5000)
    read = lm._MIDDLE[lm.levels_of(counts)]
    assert (read[:3] == [1, 2, 3]).all() and (np.abs(read - counts) <= counts * (lm.BASE - 1)).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 9, 4000)
    one, two = Counter(text.tolist()), Counter(zip(text[:-1].tolist(), text[1:].tolist(), strict=True))
    for u in range(1, 9):
        context = sum(two[u, w] for w in range(1, 9))
        words = [*range(1, 9), 99]  # 99 is any unknown one
        own = np.array([two[u, w] for w in words], dtype=float)
        p = lm.probabilities([(np.arange(9), own, np.full(9, float(context)))], np.array([one[w] for w in words], dtype=float), len(text), 8, 4.0)
        assert p.sum() == pytest.approx(1.0)


def test_tables_without_rows(docs):
    assert lm.score(docs.where("false")).collect() == []
    alone = lm.score(docs.where("doc_id is not null").where(lm.fold_of(F.col("doc_id"), 7) == 2)).collect()
    assert alone and all(r.train_tokens == 0 and r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in alone)


def test_held_out_texts_are_likelier_than_under_the_baseline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = {r.held_out: (r.s, r.b) for r in lm.score(docs).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()}
    assert sums[True][0] > 0.93 * sums[True][1] and sums[False][0] > 0.6 * sums[False][1]
