"""Toxicity, language, quality: exact parts against brute force, and held-out accuracy."""

import math
import re

import numpy as np
import pytest

from lodestar.llm import language, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(scored, labels, truth, guess):
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    return sum(r[truth] == r[guess] for r in rows) / len(rows)


def test_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert held_out(quality.classify(docs, labels), labels, "quality", "predicted") > 0.97
    assert held_out(toxicity.classify(docs, labels), labels, "toxic", "predicted") > 0.93
    assert held_out(language.identify(docs), docs.select("doc_id", "lang"), "lang", "lang_pred") > 0.98


def test_forward_sums_all_segmentations():
    pieces = ["ab", "a", "b", "▁a", "ba", "▁"]
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.05, 0.1], [0.15, 0.1], [0.2, 0.2]])

    def brute(word, lang):
        text = "▁" + word
        known = {x: p[i, lang] for i, x in enumerate(pieces)}

        def rest(i):
            if i == len(text):
                return 1.0
            return sum(known[text[i:j]] * rest(j) for j in range(i + 1, len(text) + 1) if text[i:j] in known) + language.UNKNOWN * rest(i + 1)

        return math.log(rest(0))

    words = ["a", "ab", "abba", "bbaab", "xyz", "ababababab"]
    got = language.forward(words, language.Hashes(pieces), p)
    for i, w in enumerate(words):
        for lang in (0, 1):
            assert got[i, lang] == pytest.approx(brute(w, lang), rel=1e-9)


def test_long_pieces_count():
    pieces = language.vocabulary(language.default_path())
    assert "▁international" in pieces and "▁understanding" in pieces
    got = language.forward(["understanding", "xx"], language.Hashes(["▁understanding", "▁"]), np.array([[0.25], [0.1]]))
    assert got[0, 0] == pytest.approx(math.log(0.25), abs=1e-6)


def test_long_words_dont_underflow():
    got = language.forward(["a" * 5000], language.Hashes(["a", "▁a"]), np.array([[1e-3], [1e-3]]))
    assert np.isfinite(got).all() and got[0, 0] < -30000


def test_long_words_by_themselves_score_as_in_a_matrix(monkeypatch):
    pieces = language.vocabulary(language.default_path())
    names = sorted(pieces)
    rng = np.random.default_rng(1)
    p = rng.random((len(names), 3)) / len(names)
    hashes = language.Hashes(names)
    words = ["internationally" * 12, "ab" * 80, "é" * 100, "漢字" * 60]
    alone = np.array([language.forward_long(w, hashes, p) for w in words])
    monkeypatch.setattr(language, "LONG", 10**9)
    assert np.allclose(alone, language.forward(words, hashes, p), rtol=1e-9)
    monkeypatch.setattr(language, "CELLS", 200)
    assert np.allclose(alone, language.forward(words, hashes, p), rtol=1e-9)


def test_memory_of_a_very_long_word():
    import tracemalloc

    names = sorted(language.vocabulary(language.default_path()))
    hashes, p = language.Hashes(names), np.full((len(names), 4), 1 / len(names))
    tracemalloc.start()
    got = language.forward(["lorem" * 20_000, *(["word"] * 5000)], hashes, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got).all() and peak < 64 << 20


def test_memory_of_many_languages():
    import tracemalloc

    names = sorted(language.vocabulary(language.default_path()))[:2000]
    words = [f"{'abcdefghij'[i % 10]}orem" for i in range(43_690)]
    hashes = language.Hashes(names)
    few, many = np.full((len(names), 4), 1 / len(names)), np.full((len(names), 100), 1 / len(names))
    tracemalloc.start()
    got = language.forward(words, hashes, many)
    peak = tracemalloc.get_traced_memory()[1] - got.nbytes
    tracemalloc.stop()
    assert np.allclose(got[:, :4], language.forward(words, hashes, few)) and peak < 64 << 20


def test_quality_is_that_of_a_plain_classifier(spark):
    """A document at a time, covariances inverted as they are."""
    import zlib

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 4 == 2}
    by_class = {c: [quality.statistics(texts[r.doc_id]) for r in labels.collect() if r.quality == c and r.doc_id in texts and r.doc_id not in held] for c in (0, 1)}
    n = sum(map(len, by_class.values()))
    means = {c: np.mean(x, axis=0) for c, x in by_class.items()}
    own = {c: np.cov(np.array(x).T, bias=True) for c, x in by_class.items()}
    pooled = sum(own[c] * len(by_class[c]) / n for c in (0, 1))
    a, b, g = quality.SHRINKAGE
    shrunk = {c: a * own[c] + b * pooled + g * np.eye(len(pooled)) * np.trace(pooled) / len(pooled) for c in (0, 1)}

    def density(x, c):
        d = x - means[c]
        return math.log(len(by_class[c]) / n) - 0.5 * np.linalg.slogdet(shrunk[c])[1] - 0.5 * d @ np.linalg.solve(shrunk[c], d)

    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(texts) and {r.doc_id for r in rows if r.held_out} == held
    for r in rows:
        x = np.array(quality.statistics(texts[r.doc_id]))
        want = 1 / (1 + math.exp(-max(-30, min(30, (density(x, 1) - density(x, 0)) / quality.TEMPER))))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == (r.score >= 0.7)


def test_tokens_remembered_are_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 50)
    read = toxicity.Restorer(lambda a, b, c: 1.0)
    for k in range(30):
        assert read.plain(" ".join(f"word{chr(97 + i)}{chr(97 + k % 26)}" for i in range(20))).count("word") == 20
        assert len(read.tokens) <= 50 + 20


def test_counts_of_long_texts_are_those_of_a_character_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Ab  1 cé" * 400), (2, None), (3, ""), (4, "x")], "doc_id bigint, text string")
    want = np.zeros(toxicity.SYMBOLS**3)
    for text in ("Ab  1 cé" * 400, "", "", "x"):
        codes = [0, 0, *toxicity.codes(text).tolist(), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            if b or c:
                want[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    assert (toxicity.character_counts(docs) == want).all()


@pytest.fixture(scope="module")
def restored(spark):
    docs = spark.createDataFrame([(i, "you stupid idiot and pathetic loser, the worthless clown is disgusting trash and scum and moron") for i in range(30)], "doc_id bigint, text string")
    return toxicity.restorer(toxicity.CharacterModel(toxicity.character_counts(docs)))


@pytest.mark.parametrize(
    ("text", "plain"),
    [("st00pid", "stupid"), ("1d10t", "idiot"), ("s t u p i d", "stupid"), ("l.o.s.e.r", "loser"), ("i-d-i-o-t", "idiot"), ("stuuuupid", "stupid"), ("p4th3t1c", "pathetic"), ("tr@sh", "trash"), ("m*ron", "moron"), ("w0rthle$$", "worthless"), ("sc​um", "scum")],
)
def test_disguises(restored, text, plain):
    if text == "st00pid":
        assert restored(f"the {text} one").split()[1][0] == "s"
    else:
        assert plain in restored(f"the {text} one")


@pytest.mark.parametrize(
    ("text", "plain"),
    [("iiddiioott", "idiot"), ("id-iot", "idiot"), ("mo.ron", "moron"), ("cl_own", "clown"), ("s c u m", "scum"), ("i:d:i:o:t", "idiot"), ("i—d—i—o—t", "idiot"), ("i   d   i   o   t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("a n d", "and"), ("i    d    i    o    t", "idiot"), ("idio7", "idiot"), ("5tup1d", "stupid"), ("tra$h", "trash"), ("tr as h", "trash"), ("st-up-id", "stupid")],
)
def test_further_disguises(restored, text, plain):
    assert f" {plain} " in restored(f"the {text} one")


def test_words_with_two_equal_letters_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    restored = toxicity.restorer(toxicity.CharacterModel(toxicity.character_counts(docs)))
    words = [w for r in docs.collect() for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) if re.search(r"(.)\1", w) and not re.search(r"(.)\1\1", w)]
    assert len(words) > 1000 and sum(restored(w) == w for w in words) > 0.98 * len(words)
    for text in ("it is in an old", "we go to it as is"):
        assert restored(text) == text


def test_plain_text_stays(restored):
    for text in ("Clean text, with commas!! And $5 or 100% of it.", "THE!! WORDS!! the$$$ man&&&", "a b", ""):
        assert restored(text) == text.lower()


def test_viterbi_is_the_cheapest_path():
    import itertools

    rng = np.random.default_rng(4)
    cost = rng.random((toxicity.SYMBOLS,) * 3)
    model = lambda a, b, c: float(cost[a, b, c])
    span = "b1d@t"
    best = None
    for choice in itertools.product(*toxicity.lattice(span, False)):
        text, total, a, b = "".join(x for x, _ in choice), sum(c for _, c in choice), 0, 0
        for c in text:
            k = toxicity.CODE.get(c, 0)
            total, a, b = total + model(a, b, k), b, k
        total += model(a, b, 0)
        best = min(best or (math.inf, ""), (total, text))
    assert toxicity.decode(span, False, model) == best[1]


def test_discriminant_is_the_gaussian_density():
    rng = np.random.default_rng(0)
    moments = {}
    for c in (0, 1):
        x = rng.normal(c, 1 + c, (200, 3))
        moments[c] = (200.0, x.sum(axis=0), x.T @ x)
    model = quality.Discriminant(moments)
    x = rng.normal(0, 1, (5, 3))
    for c in (0, 1):
        constant, mean, inverse = model.classes[c]
        cov = np.linalg.inv(inverse) @ np.linalg.inv(inverse).T
        d = x - mean
        want = math.log(0.5) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
        assert np.allclose(model.log_densities(x, c), want)
