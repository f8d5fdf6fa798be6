"""Toxicity of text whose words may be disguised.

A noisy channel writes letters as look-alike signs, spells words out with
separators and repeats letters. Spans that allow another reading become a character
lattice; Viterbi decoding under a character trigram model, counted over all
texts, finds the likeliest plain spelling. A text without such spans is a lattice
with one path and stays as it is. The restored text is then scored by word and
word-beginning features weighted by their log odds in labelled documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.storagelevel import StorageLevel

from .common import fold_of

# Signs that stand for letters, and signs that are put between letters.
SIGNS = {"*": "aeiou", "0": "ou", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*·,/\\~'"
INVISIBLE = tuple("­​‌‍⁠﻿")

# Costs in nats: a sign read as a letter, a sign or separator kept as a gap, one letter too many or two kept of a long run.
COST_SIGN, COST_GAP, COST_RUN = 0.7, 5.0, 0.5
# A letter that is read once though it stands twice, if less than half of the others do, and a separator passed over inside a word.
COST_DOUBLE, COST_JOIN = 6.0, 2.0
# A sign that is none where a word ends.
COST_END = 1.0

_L = r"[^\W\d_]"
_S = "[" + re.escape("".join(SIGNS)) + "]"
#: One sign of any kind, or a run of white space.
_D = r"(?:[^\w\s]|_|\s+)"
_X = f"(?:{_L}|{_S})"
#: Signs that are letters at the end of a word more often than they end a sentence; three equal ones are ornament there.
_E = "[" + re.escape("".join(c for c in SIGNS if c not in "!|+*")) + "]"
#: Letters spelled out one by one; fragments of one or two letters; a sign between or before letters, a letter twice, a separator between letters.
SPELLED = re.compile(rf"(?<![^\W_])(?<!{_S}){_X}(?:({_D}){_X}(?![^\W_]|{_S})(?=\1|\W|$)){{2,}}")
FRAGMENTS = re.compile(rf"(?<!\w){_L}{{1,2}}(?:\s{_L}{{1,2}}(?!\w)){{2,}}")
TRACE = re.compile(rf"(?<={_L}){_S}+(?={_L})|(?<![\w]){_S}{{1,3}}(?={_L})|({_L})\1|(?<={_L})(?:[^\w\s]|_)(?={_L})|(?<={_L})(?!(?P<o>.)(?P=o)(?P=o)){_E}+(?=[\W_]*$)")
RUN = re.compile(rf"({_L})\1*")
DOUBLED = re.compile(r"(.)\1")
WHITE = re.compile(r"(\s+)")

GAP = 0
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
OTHER = len(ALPHABET) + 1
SYMBOLS = 64
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
_TABLE = np.zeros(0x250, dtype=np.int64)
for _c in range(0x250):
    _TABLE[_c] = CODE.get(chr(_c), OTHER if chr(_c).isalpha() else GAP)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], OTHER)


class CharacterModel:
    """Interpolated trigram model over letters and word gaps."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.0
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        uniform = 1 / SYMBOLS
        p1 = (one + 1) / (one.sum() + 1 / uniform)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        self.cost = (-np.log((three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20))).ravel().tolist()

    def __call__(self, a: int, b: int, c: int) -> float:
        return self.cost[(a * SYMBOLS + b) * SYMBOLS + c]


def lattice(span: str, spelled: bool) -> list[list[tuple[str, float]]]:
    """For each step the ways to read it: emitted letters and what they cost. A gap is a space; plain letters in a row are one step."""
    steps, i = [], 0
    runs = [len(r.group()) for r in RUN.finditer(span)]
    double = COST_RUN + (COST_DOUBLE - COST_RUN) * min(1.0, 2 * runs.count(1) / max(1, len(runs)))  # less where most letters are repeated
    while i < len(span):
        c = span[i]
        j = i
        while j < len(span) and span[j] == c:
            j += 1
        if c.isalpha():
            if j - i >= 3:
                steps.append([(c, COST_RUN), (c + c, COST_RUN)])
            elif j - i == 2:
                steps.append([(c + c, 0.0), (c, double)])
            elif steps and len(steps[-1]) == 1 and steps[-1][0][0] != " ":
                steps[-1] = [(steps[-1][0][0] + c, 0.0)]
            else:
                steps.append([(c, 0.0)])
        elif c in SIGNS:
            apart = [("", 0.0)] if spelled and c in SEPARATORS else []
            ends = not any(map(str.isalpha, span[j:]))
            for k in range(j - i):
                steps.append([(x, COST_SIGN) for x in SIGNS[c]] + apart + [(" ", (0.0 if k else COST_END) if ends else COST_GAP)])
        elif spelled:
            steps.append([("", 0.0), (" ", COST_GAP)])
        elif j - i == 1 and not c.isdigit() and 0 < i and span[i - 1].isalpha() and span[j : j + 1].isalpha():
            steps.append([(" ", 0.0), ("", COST_JOIN)])
        else:
            steps.append([(" ", 0.0)])
        i = j
    return steps


def decode(span: str, spelled: bool, model) -> str:
    """Cheapest reading of a span: channel cost plus the model's, over pairs of last symbols."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(GAP, GAP): (0.0, ())}
    for options in lattice(span, spelled):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        coded = [(emitted, extra, [CODE.get(c) or (OTHER if c.isalpha() else GAP) for c in emitted]) for emitted, extra in options]
        for (a, b), (cost, path) in best.items():
            for emitted, extra, symbols in coded:
                x, y, total = a, b, cost + extra
                for k in symbols:
                    total += model(x, y, k)
                    x, y = y, k
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (path, emitted) if emitted else path)
        best = new
    cost, path = min(((cost + model(a, b, GAP), path) for (a, b), (cost, path) in best.items()), key=lambda f: f[0])
    parts = []
    while path:
        path, emitted = path
        parts.append(emitted)
    return "".join(reversed(parts))


NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Tokens whose plain reading a task remembers.
REMEMBERED = 30_000


class Restorer:
    """Reads disguised spans of texts in their likeliest plain spelling.

    Letters that are spelled out, and short fragments, are read across white
    space. All other traces lie within a token, whose reading depends on nothing
    else, so each token is read once however often it occurs.
    """

    def __init__(self, model):
        self.read = lru_cache(maxsize=REMEMBERED)(lambda span, spelled: decode(span, spelled, model))
        self.tokens: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        """The text in lower case, all but disguised spans as it is."""
        return "".join(part if k % 2 else self._token(part) for k, part in enumerate(WHITE.split(self._joined(text))))

    def plain(self, text: str | None) -> str:
        """The restored text's words, letters only, a space around each."""
        found = self._joined(text).split()
        if len(self.tokens) > REMEMBERED:
            self.tokens.clear()
        for token in set(found).difference(self.tokens):
            self.tokens[token] = NOT_LETTERS.sub(" ", self._token(token)).strip()
        return f" {' '.join(filter(None, map(self.tokens.__getitem__, found)))} "

    def _joined(self, text: str | None) -> str:
        text = (text or "").lower()
        for c in INVISIBLE:
            text = text.replace(c, "")
        for pattern, spelled in ((SPELLED, True), (FRAGMENTS, False)):
            text = pattern.sub(lambda found: self.read(found.group(), spelled), text)  # noqa: B023
        return text

    def _token(self, token: str) -> str:
        found = None if token.isalpha() and not DOUBLED.search(token) else TRACE.search(token)
        if not found:
            return token
        end = len(token)
        while end > found.end() and not (token[end - 1].isalnum() or (token[end - 1] in SIGNS and token[end - 1] not in "!|+")):
            end -= 1
        return self.read(token[:end], False) + token[end:]


restorer = Restorer
_own: list[tuple[bytes, Restorer]] = []


def own_restorer(counts: np.ndarray) -> Restorer:
    """The restorer of these trigram counts; a worker keeps the last one, so that its tasks share what it remembers."""
    key = hashlib.blake2b(counts.tobytes(), digest_size=16).digest()
    if not _own or _own[0][0] != key:
        _own[:] = [(key, Restorer(CharacterModel(counts)))]
    return _own[0][1]


#: Characters that are counted at once.
COUNTED = 1 << 20


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; tasks send at most SYMBOLS**3 sums each, as does the result."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            joined = "  ".join(text or "" for text in batch.column(0).to_pylist())
            for lo in range(0, len(joined) + 1, COUNTED):  # neighbours share two symbols
                c = codes(f"  {joined} "[lo : lo + COUNTED + 2])
                kept = (c[1:-1] != GAP) | (c[2:] != GAP)  # runs of gaps count once
                total += np.bincount(((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:])[kept], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    counts = np.zeros(SYMBOLS**3)
    for row in docs.select(F.col("text").cast("string")).mapInArrow(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row.code] = row.n
    return counts


def features(text: str) -> set[str]:
    """Whole words and their first 3 to 6 letters, as strings that can be searched in restored text."""
    found = set()
    for word in set(text.split()):
        found.add(f" {word} ")
        found.update(f" {word[:k]}" for k in range(3, min(6, len(word)) + 1))
    return found


class Automaton:
    """Finds weighted features in a text; gives the statistics that the score uses."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.machine = None
        if weights:
            self.machine = ahocorasick.Automaton()
            for i, (feature, weight) in enumerate(weights.items()):
                self.machine.add_word(feature, (i, weight))
            self.machine.make_automaton()

    def ids(self, text: str) -> dict[int, float]:
        return {i: w for _, (i, w) in self.machine.iter(text)} if self.machine else {}

    def statistics(self, text: str) -> tuple[float, float, float]:
        found = sorted(self.ids(text).values(), reverse=True)
        return (found[0], math.log1p(len(found)), found[0] * math.log1p(len(found))) if found else (0.0, 0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one for the constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Labelled documents that the classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Toxic documents of the sample that a feature must occur in, and its least log odds. The sample bounds the number of features.
SUPPORT, LEAST_ODDS = 5, 1.5


def fit(docs: DataFrame, labels: DataFrame, counts: np.ndarray, modulus: int = 5, held: int = 0, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Feature weights and logistic weights from at most ``sample`` labelled rows outside the held-out fold.

    The sample's bound holds at every size of the corpus; equal texts in it count once.
    """
    spark = docs.sparkSession
    train = labels.where((fold_of(F.col("doc_id"), modulus) != held) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    model = spark.sparkContext.broadcast(counts)

    def restore_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restored = own_restorer(model.value).plain
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([restored(t) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["text", "toxic"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(train), "doc_id")  # at most ``sample`` pairs of numbers
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    texts = texts.mapInArrow(restore_all, "text string, toxic int").persist(StorageLevel.MEMORY_AND_DISK)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for t in batch.column(0).to_pylist() for f in features(t)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["feature"])

    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    candidates = texts.where("toxic = 1").select("text").mapInArrow(listed, "feature string").groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    toxic_counts = {r.feature: r.n for r in candidates.orderBy(F.desc("n"), "feature").collect()}
    names = list(toxic_counts)
    shared = spark.sparkContext.broadcast(dict.fromkeys(names, 1.0))

    def clean_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, total = Automaton(shared.value), np.zeros(max(1, len(names)), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for i in machine.ids(t):
                    total[i] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    clean_counts = {r.i: r.n for r in texts.where("toxic = 0").select("text").mapInArrow(clean_hits, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    odds = {f: math.log((toxic_counts[f] + 0.5) / (sizes.get(1, 0) + 1)) - math.log((clean_counts.get(i, 0) + 0.5) / (sizes.get(0, 0) + 1)) for i, f in enumerate(names)}
    kept = dict(sorted(((f, w) for f, w in odds.items() if w >= LEAST_ODDS), key=lambda x: (-x[1], x[0])))
    weights = spark.sparkContext.broadcast(kept)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(weights.value)
        for batch in batches:
            rows = [machine.statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), batch.column(1)], names=["a", "b", "c", "toxic"])

    rows = texts.mapInArrow(measured, "a double, b double, c double, toxic int").collect()  # at most ``sample`` short rows
    texts.unpersist()
    if len({r.toxic for r in rows}) < 2:
        constant = 0.0 if not rows else (20.0 if rows[0].toxic else -20.0)
        return kept, np.array([0.0, 0.0, 0.0, constant])
    return kept, logistic(np.array([[r.a, r.b, r.c] for r in rows]), np.array([float(r.toxic) for r in rows]))


def score(docs: DataFrame, counts: np.ndarray, model: tuple[dict[str, float], np.ndarray], modulus: int = 5, held: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; with ``keep``, these columns and score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, *model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights, line = shared.value
        restored, machine = own_restorer(own).plain, Automaton(weights)
        for batch in batches:
            rows = np.array([machine.statistics(restored(t.as_py())) for t in batch.column(1)]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(rows @ line[:-1] + line[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), modulus) == held, F.lit(False))
    carried = F.struct(*keep) if keep else F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"))
    rows = docs.select(carried.alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rows.mapInArrow(scored, schema).select("row.*", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE, keep: Sequence[str] = ()) -> DataFrame:
    """Fit on labelled rows, then score every row of ``docs``.

    Takes ``doc_id`` and ``text`` of documents, ``doc_id`` and ``toxic`` of labels;
    other columns are not read. A null text is scored as an empty one; a null
    doc_id is never held out nor matched with a label. Repeated rows repeat in
    the result. Where no labels, or those of one class only, are known, all
    scores are equal (0.5, or near that class). An empty table gives no rows.
    """
    counts = character_counts(docs)
    return score(docs, counts, fit(docs, labels, counts, modulus, held, sample), modulus, held, keep)
