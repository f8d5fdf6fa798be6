"""Quality by regularised quadratic discriminant analysis.

Each text gives a few statistics, transformed towards normal shape. Each class
has a mean and a covariance shrunk towards the pooled one and a multiple of the
identity. A score is the posterior from the difference of the two Gaussian log
densities; Mahalanobis distances come from Cholesky factors computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import fold_of

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper", "upper_words",
    "digits", "signs", "bars", "signed_words", "ends", "log_line", "distinct_lines", "worst_line",
)
SIGNS = set("#$%&*!|@^~<>{}[]=+_\\/")
_ENDS = ".,;:!?"
#: Weights of the class covariance, the pooled one and the identity's multiple.
SHRINKAGE = (0.85, 0.10, 0.05)
#: The log-density difference is divided by this, as the statistics of a text are not independent of each other.
TEMPER = 4.0


def _odd(words: list[str]) -> int:
    """Words in capitals, bars, or words with a sign at their end."""
    return sum(1 for w in words if w[-1] in SIGNS or (len(w) > 3 and w.isupper()))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m, k = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    seen = Counter(words)
    share = lambda count, of: math.sqrt(count / of)
    odd_by_line = [(_odd(own), len(own)) for own in (x.split() for x in lines)]
    repeats = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(text) / m), len(seen) / m, share(max(seen.values(), default=0), m), share(repeats, m),
        share(sum(map(str.isupper, text)), n), share(sum(1 for w in words if len(w) > 1 and w.isupper()), m),
        share(sum(map(str.isdigit, text)), n), share(sum(map(text.count, SIGNS)), n), share(text.count("|"), m), share(sum(o for o, _ in odd_by_line), m),
        share(sum(map(text.count, _ENDS)), m), math.log1p(len(text) / k), len(set(lines)) / k, share(max((o for o, _ in odd_by_line), default=0), 1 + max((s for _, s in odd_by_line), default=0)),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row: the statistics of its whole text; a null text is an empty one."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(measured, "doc_id bigint, x array<double>")


class Discriminant:
    """Two Gaussians with cached inverse Cholesky factors, from (n, sum, sum of products) of each class."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.classes = {}
        total = sum(n for n, _, _ in moments.values())
        own, pooled = {}, 0.0
        for c, (n, s, q) in moments.items():
            mean = s / n
            own[c] = (n, mean, q / n - np.outer(mean, mean))
            pooled = pooled + own[c][2] * n / total
        for c, (n, mean, cov) in own.items():
            d = len(mean)
            ridge = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
            shrunk = SHRINKAGE[0] * cov + SHRINKAGE[1] * pooled + SHRINKAGE[2] * ridge
            factor = np.linalg.cholesky(shrunk)
            self.classes[c] = (math.log(n / total) - np.log(np.diag(factor)).sum(), mean, np.linalg.inv(factor))

    def log_densities(self, x: np.ndarray, c: int) -> np.ndarray:
        constant, mean, inverse = self.classes[c]
        return constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if set(self.classes) != {0, 1}:
            return np.full(len(x), 1.0 if 1 in self.classes else 0.0 if 0 in self.classes else 0.5)
        difference = (self.log_densities(x, 1) - self.log_densities(x, 0)) / TEMPER
        return 1 / (1 + np.exp(-np.clip(difference, -30, 30)))


def fit(measured: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> Discriminant:
    """Moments of each class over all labelled rows outside the held-out fold; the driver gets sums only."""
    d = len(STATISTICS)
    known = labels.where((fold_of(F.col("doc_id"), modulus) != held) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            y = np.array(batch.column(0).to_pylist())
            for c in (0, 1):
                own = np.hstack([np.ones((int((y == c).sum()), 1)), x[y == c]])
                sums[c] = sums.get(c, 0.0) + own.T @ own
        rows = [(c, i, v) for c, s in sums.items() for i, v in enumerate(s.ravel())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in zip(*rows, strict=True)], names=["c", "i", "v"])

    rows = measured.join(known, "doc_id").select("quality", "x").mapInArrow(summed, "c bigint, i bigint, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    moments = {}
    for c in (0, 1):
        s = np.zeros((d + 1) ** 2)
        for r in rows:
            if r.c == c:
                s[r.i] = r.v
        s = s.reshape(d + 1, d + 1)
        if s[0, 0]:
            moments[c] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return Discriminant(moments)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Takes ``doc_id`` and ``text`` of documents, ``doc_id`` and ``quality`` of
    labels; other columns are not read. A null text is scored as an empty one; a
    null doc_id is never held out nor matched with a label. Repeated rows repeat
    in the result. Where only one class is labelled all scores are that class's;
    without labels they are 0.5. An empty table gives no rows.
    """
    measured = measure(docs).persist(StorageLevel.MEMORY_AND_DISK)  # 16 numbers a document
    model = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, modulus, held))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(np.array(batch.column(2).to_pylist()).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), modulus) == held, F.lit(False))
    return measured.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
