import random
import re

import numpy as np

from lodestar.llm import minhash

WORDS = [f"w{i}" for i in range(400)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def family(rng, size, edits, words=80):
    base = [rng.choice(WORDS) for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS).upper()
        yield " ".join(copy)


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for edits in (2, 4, 6, 9):  # the larger families link up in part only
        texts += family(rng, 60, edits)
    texts += ["a b", "A  B", "a b c d e", "", "é é é é é"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(minhash.group(docs).collect())
    want, sizes = brute(texts)
    assert [r["component_id"] for r in rows] == want
    assert [r["n_shingles"] for r in rows] == sizes
    assert [r["kept"] for r in rows] == [r["doc_id"] == r["component_id"] for r in rows]


def test_blocks_of_large_buckets_lose_no_link(spark):
    rng = random.Random(6)
    texts = [t for edits in (4, 7, 9) for t in family(rng, 40, edits)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.linked(docs, together=3).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)[0]


def test_all_pairs_within_the_radius_share_a_bucket(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, minhash.VALUES, dtype=np.uint16)
    rows = []
    for i in range(40):
        other = base.copy()
        other[rng.permutation(minhash.VALUES)[: minhash.RADIUS]] += np.uint16(1)
        rows += [(2 * i + 1, bytes(other.tobytes() + bytes(minhash.SKETCH // 8)))]
    rows.append((0, base.tobytes() + bytes(minhash.SKETCH // 8)))
    entered = minhash.buckets(spark.createDataFrame(rows, "class_key bigint, signature binary")).collect()
    of = {}
    for r in entered:
        of.setdefault(r["class_key"], set()).add(r["bucket"])
    assert all(of[0] & of[k] for k, _ in rows)


def test_sketches_never_overstate():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 200)], rng.integers(0, 1 << 63, rng.integers(1, 100), dtype=np.uint64)]))
        x, y = minhash.sketches([a, b]).view(np.uint64)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    from lodestar.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100)], "a bigint, b bigint")
    found = dict(components(edges).collect())
    assert all(found[i] == 1 for i in range(1, 61)) and {found[i] for i in (100, 101, 102)} == {100}


def test_components_of_long_chains_in_any_order(spark):
    from lodestar.llm.components import components

    rng = random.Random(13)
    ids = rng.sample(range(10_000), 3000)
    chains = [ids[:1000], sorted(ids[1000:2000]), ids[2000:2500], ids[2500:]]
    edges = [e for c in chains for e in zip(c[:-1], c[1:], strict=True)]
    found = dict(components(spark.createDataFrame(rng.sample(edges, len(edges)), "a bigint, b bigint")).collect())
    assert found == {v: min(c) for c in chains for v in c}


def test_rounds_keep_estimates_short(spark):
    from lodestar.llm import spelling
    from lodestar.llm.components import components

    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "a bigint, b bigint"))
    assert size(chain) < 1 << 30  # a product of estimates a round has hundreds of thousands of digits
    words = spelling.roots(spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(200)], "word string, form string"))
    assert size(words) < 1 << 30 and {tuple(r) for r in words.collect()} == {(f"w{i:03}", "w200") for i in range(200)}


def test_later_rounds_load_missing_sets(spark, monkeypatch):
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        words = rng.choices(WORDS, k=200)
        texts += [" ".join(words), " ".join(words[:-2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    within, partners = minhash.within_radius, minhash.partners
    monkeypatch.setattr(minhash, "within_radius", lambda *a: within(*a).where("false"))
    # the sketch ranks others first, all tested, but for one class
    monkeypatch.setattr(minhash, "partners", lambda e, r, nearest, p: partners(e, r, nearest, p).orderBy("a", "b").limit(1) if nearest else partners(e, r, nearest, p))
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    assert {r["doc_id"]: r["component_id"] for r in minhash.group(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
