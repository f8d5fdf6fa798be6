"""Language identification by segmentation-marginalised piece unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities (forward algorithm); a text's is the product
over its words. Pieces don't cross words, so the forward pass runs once for
each distinct word of a slice of texts, for all words of the slice at once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

LETTERS = re.compile(r"[^\W\d_]+")
#: Characters of text handled at once, and cells of the matrix that words are padded into, for four languages; more have as much fewer.
SLICE, CELLS = 2_000_000, 1 << 18
#: Letters from which a word is gone through by itself.
LONG = 200
#: Pseudo-count of each piece in each language, and the probability of a character that no piece covers.
SMOOTHING, UNKNOWN = 0.5, 1e-8
UNDETERMINED = "und"
START = "▁"
TABLE_BITS = 20
#: Multiplier of the polynomial hash, odd so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a byte-level BPE rank file that are whole letters, by rank; a leading space becomes START."""
    import base64

    pieces = {}
    with open(path, "rb") as lines:
        for line in lines:
            if not line.strip():
                continue
            token, rank = line.split()
            try:
                text = base64.b64decode(token).decode()
            except UnicodeDecodeError:
                continue
            body = text.removeprefix(" ")
            if LETTERS.fullmatch(body) and body == body.lower():
                pieces[(START if body != text else "") + body] = int(rank)
    return pieces


class Hashes:
    """Finds the pieces that begin at each character of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.index = {p: i for i, p in enumerate(pieces)}
        self.keys = np.array([self._key(p) for p in pieces], dtype=np.uint64)
        self.slots = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.shared = np.zeros(1 << TABLE_BITS, dtype=bool)  # slots that several pieces want
        self.more: dict[int, int] = {}
        for i, slot in enumerate(self._slot(self.keys)):
            if self.slots[slot] < 0:
                self.slots[slot] = i
            else:
                self.shared[slot] = True
                self.more[int(self.keys[i])] = i

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for c in piece:
            key = (key * int(BASE) + ord(c)) % (1 << 64)
        return key

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        ids = self.slots[slots]
        ids = np.where((ids >= 0) & (self.keys[ids] == keys), ids, -1)
        for at in np.flatnonzero(self.shared[slots]):
            ids[at] = self.more.get(int(keys[at]), ids[at])
        return ids


def forward(words: list[str], hashes: Hashes, probabilities: np.ndarray, unknown: float = UNKNOWN) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations.

    ``probabilities`` has a row a piece and a column a language. Words are padded
    into a matrix and the pass goes over columns, longest words first, so that
    each step is one array operation for all words that are still running.
    Alphas are rescaled every few columns, as long words underflow otherwise. A
    matrix has CELLS cells at most, over four languages fewer, so that memory
    doesn't grow with their number; words from LONG letters on take no matrix.
    """
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    cells = 4 * CELLS // max(4, probabilities.shape[1])
    out = np.zeros((len(words), probabilities.shape[1]))
    lo = 0
    while lo < len(order):
        if len(words[order[lo]]) >= LONG:
            out[order[lo]] = forward_long(words[order[lo]], hashes, probabilities, unknown)
            lo += 1
            continue
        part = order[lo : lo + max(1, cells // (len(words[order[lo]]) + 1))]
        lo += len(part)
        lengths = np.array([len(words[i]) + 1 for i in part])
        width = int(lengths[0])
        codes = np.zeros((len(part), width), dtype=np.uint64)
        flat = np.frombuffer((START + START.join(words[i] for i in part)).encode("utf-32-le"), dtype=np.uint32)
        rows = np.repeat(np.arange(len(part)), lengths)
        starts = np.cumsum(lengths) - lengths
        codes[rows, np.arange(len(flat)) - starts[rows]] = flat
        running = np.searchsorted(-lengths, -np.arange(width), side="left")  # words longer than a column's number
        alpha = np.zeros((min(hashes.longest, width) + 1, len(part), probabilities.shape[1]))
        depth = len(alpha)
        alpha[0] = 1.0
        scale = np.zeros(len(part))
        keys = np.zeros((depth, len(part)), dtype=np.uint64)  # hash of the k characters that end here
        for column in range(width):
            n = int(running[column])
            c = codes[:n, column]
            for k in range(min(depth - 1, column + 1), 1, -1):
                keys[k, :n] = keys[k - 1, :n] * BASE + c
            keys[1, :n] = c
            total = alpha[column % depth, :n] * unknown
            for k in range(1, min(depth - 1, column + 1) + 1):
                ids = hashes.find(keys[k, :n])
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    total[hit] += alpha[(column + 1 - k) % depth][hit] * probabilities[ids[hit]]
            alpha[(column + 1) % depth, :n] = total
            ended = np.flatnonzero(lengths[:n] == column + 1)
            if len(ended):
                out[np.array(part)[ended]] = np.log(total[ended]) + scale[ended, None]
            if column % 4 == 3:  # keep the ring in range
                top = total.max(axis=1)
                alpha[:, :n] /= top[None, :, None]
                scale[:n] += np.log(top)
    return out


def forward_long(word: str, hashes: Hashes, probabilities: np.ndarray, unknown: float = UNKNOWN) -> np.ndarray:
    """The same for one word, in memory of the longest piece: the alphas of the last places only."""
    text = START + word
    alphas, scale = deque([np.ones(probabilities.shape[1])], maxlen=hashes.longest), 0.0
    for end in range(1, len(text) + 1):
        total = alphas[-1] * unknown
        for k in range(1, min(hashes.longest, end, len(alphas)) + 1):
            i = hashes.index.get(text[end - k : end])
            if i is not None:
                total = total + alphas[-k] * probabilities[i]
        alphas.append(total)
        if end % 16 == 0:
            top = float(total.max())
            for i in range(len(alphas)):
                alphas[i] = alphas[i] / top
            scale += math.log(top)
    return np.log(alphas[-1]) + scale


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about SLICE characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > SLICE:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame, modulus: int = 5, held: int = 0, path: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """Pieces, languages and a matrix of probabilities, from all rows with a language outside the held-out fold.

    Piece counts come from the vocabulary's own segmentation of every training
    text; tasks add them up by language before the shuffle. The driver gets
    languages x pieces numbers, a bound that doesn't grow with the corpus.
    """
    path = path or default_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .packing import encoder

        encode, sums = encoder(path).encode_to_numpy, {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                by: dict[str, list[str]] = {}
                for text, lang in zip(texts[a:b], langs[a:b], strict=True):
                    by.setdefault(lang, []).extend(LETTERS.findall(text.lower()))
                for lang, found in by.items():
                    ids = encode(" " + " ".join(found), disallowed_special=())
                    got = np.bincount(ids, minlength=1 << 16)
                    sums[lang] = sums[lang] + got if lang in sums else got
        rows = [(lang, int(i), int(n)) for lang, counts in sums.items() for i, n in zip(np.flatnonzero(counts), counts[counts > 0], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["lang", "piece", "n"])

    train = docs.where((fold_of(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = train.mapInArrow(counted, "lang string, piece bigint, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    known = vocabulary(path)
    pieces = sorted(known)
    column = {lang: i for i, lang in enumerate(languages)}
    row = {known[p]: i for i, p in enumerate(pieces)}
    counts = np.full((len(pieces), len(languages)), SMOOTHING)
    for r in rows:
        if r.piece in row:
            counts[row[r.piece], column[r.lang]] += r.n
    return pieces, languages, counts / counts.sum(axis=0, keepdims=True)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], modulus: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, in the rows' own order and number.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text, or one
    without letters, is ``und`` with score 0, as is every text where the training
    rows had no language. Ties go to the first language by code point. Repeated
    rows repeat in the result; an empty table gives no rows.
    """
    pieces, languages, probabilities = model
    shared = docs.sparkSession.sparkContext.broadcast((pieces, probabilities))  # languages x pieces numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, p = shared.value
        hashes = Hashes(own)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = [], []
            for a, b in _slices(texts):
                index: dict[str, int] = defaultdict(count().__next__)
                tokens = [[index[w] for w in LETTERS.findall(t.lower())] if t else [] for t in texts[a:b]]
                table = forward(list(index), hashes, p) if languages and index else None
                for found in tokens:
                    if not found or table is None:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    logs = table[found].sum(axis=0)
                    best = int(np.argmax(logs))
                    names.append(languages[best])
                    scores.append(float(1 / np.exp(logs - logs[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(fold_of(F.col("doc_id"), modulus) == held, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 5, held: int = 0, path: str | None = None) -> DataFrame:
    """Fit on all training rows of ``docs``, then predict every row."""
    return predict(docs, fit(docs, modulus, held, path), modulus, held)
