"""Language-model scores from a log-frequency Bloom filter.

A filter holds an n-gram's quantised count: level 1 + floor(log_b(count)) is
held as that many keys, (n-gram, 1), (n-gram, 2), ... A count is read by probing
level after level until one is missing, so it is never read too low, and each
level too high is as unlikely as a false positive. Probabilities interpolate the
orders: p(w | u v) = (c(u v w) + M p(w | v)) / (c(u v) + M), down to add-one counts
of single tokens.

Counting: tasks count the n-grams of some million tokens at a time, sort them,
and send them on as blocks by segment, the upper bits of the n-gram's hash. A
segment's blocks are added up in one task, which builds the segment's part of
the filter. The number of segments follows the input, so a segment has a bound.

Scoring: a filter of at most MOST_FILTER bytes is broadcast. A larger one stays
where it is, and what a slice of documents wants to know is sent to the segments
and back; both ways give the same scores. Exact counts of single tokens, which the
baseline needs, are broadcast for the commonest words and joined for the rest.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import cut, fold_of

ORDER = 2
#: Counts are held to this factor.
BASE = 1.5
#: Bits that a key sets in one word of 64, and bits of the filter for each key: one that isn't there is found less than once in 100 times.
PROBES = 5
BITS = 12
#: Weight of the lower order, in occurrences of the context.
MASS = 30.0
MOST_FILTER = 256 << 20
#: Words whose exact counts are broadcast, at most, of 24 bytes each.
MOST_WORDS = 1 << 19
#: Bytes of text a segment, tokens that a task counts before it sends them on, and bytes that are split at a time.
SEGMENT, TOKENS, SLICE = 4 << 20, 1 << 20, 2 << 20
#: Bytes of text that ask the segments together: the more, the fewer distinct n-grams a token.
ASKING = 16 << 20
#: Partitions that segments are dealt to, at most; each is gone through segment by segment.
MOST_PARTITIONS = 1 << 14
END = b""
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LEVEL = np.arange(256, dtype=np.uint64) * _GOLD
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(32))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)), by comparison with the powers, so that no rounding of logarithms matters."""
    return np.searchsorted(_POWERS, counts, side="right")


_POWERS = np.ceil(BASE ** np.arange(160) - 1e-9).astype(np.float64)
#: What a level stands for: the middle of the whole numbers that have it, 0 for none.
_MIDDLE = np.r_[0.0, (_POWERS[:-1] + np.maximum(_POWERS[1:] - 1, _POWERS[:-1])) / 2]


def split(raw: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text in lower case (A to Z only), a block at a time; words are what space and U+0009 to U+000D separate."""
    at = 0
    while at < len(raw):
        end = at + block
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].lower().split()
        at = end


class Tokens:
    """Tokens of some texts: ``ids`` into distinct words, whose hashes are ``lo`` and ``hi``; each text ends with END, which is word 0."""

    def __init__(self, raws: list[bytes | None]):
        index: dict[bytes, int] = defaultdict(count().__next__)
        parts, end = [], np.full(1, index[END], dtype=np.int64)
        self.sizes = np.zeros(len(raws), dtype=np.int64)
        for i, raw in enumerate(raws):
            for words in split(raw or b""):
                parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                self.sizes[i] += len(words)
            parts.append(end)
            self.sizes[i] += 1
        self.ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        digests = np.frombuffer(b"".join(map(xxh3_128_digest, index)), dtype=np.uint64).reshape(-1, 2)
        self.lo, self.hi = digests[:, 0].copy(), digests[:, 1].copy()

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray, lo: np.ndarray) -> Tokens:
        """Tokens that were made before, without the words' other hashes."""
        tokens = cls.__new__(cls)
        tokens.ids, tokens.sizes, tokens.lo = ids.astype(np.int64), sizes.astype(np.int64), lo
        return tokens

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each order from 2 on: the places that have so many tokens before them, the distinct n-grams that end there, and which of them does."""
        before, places = [], np.arange(len(self.ids))
        for k in range(1, order):
            shifted = np.r_[np.zeros(k, dtype=np.int64), self.ids[:-k]][: len(self.ids)]
            if k > 1:  # a context that begins with the text is as long as it is
                places = places[before[-1][places] != 0]
                shifted[before[-1] == 0] = 0
            before.append(shifted)
            key = self.lo[shifted[places]]
            for ids in [*before[-2::-1], self.ids]:
                key = _mix(key * _GOLD + self.lo[ids[places]])
            yield places, *np.unique(key, return_inverse=True)


def _slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Runs of texts of about ``most`` bytes, with their bounds; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i, column.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths), column.slice(start).to_pylist()


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (of one or more columns), sorted, and the sums of their counts."""
    if not len(counts):
        return keys, counts
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys, counts = [k[order] for k in keys], counts[order]
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    return [k[first] for k in keys], np.add.reduceat(counts, first)


def _blocks(order: int, keys: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    keys, counts = _summed(keys, counts)
    edges = np.searchsorted(_segment(keys[0], bits), np.arange((1 << bits) + 1)) if len(counts) > 1 << bits else None
    of = _segment(keys[0], bits)
    if edges is None:
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
        bounds = zip(starts, np.r_[starts[1:], len(of)], strict=True)
    else:
        bounds = zip(edges[:-1], edges[1:], strict=True)
    for a, b in bounds:
        if b > a:
            yield int(of[a]), order, b"".join([*(k[a:b].tobytes() for k in keys), counts[a:b].astype(np.uint32).tobytes()])


def _read(order: int, block: pa.Buffer) -> tuple[list[np.ndarray], np.ndarray]:
    width = 2 if order == 1 else 1
    n = block.size // (8 * width + 4)
    return [np.frombuffer(block, np.uint64, n, 8 * n * i) for i in range(width)], np.frombuffer(block, np.uint32, n, 8 * n * width).astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_BLOCK = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])
_PART = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("size", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])


def _counter(order: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[list[np.ndarray], np.ndarray]]] = defaultdict(list)
        n = 0

        def told() -> pa.RecordBatch:
            rows = []
            for k, parts in held.items():
                keys = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
                rows += _blocks(k, keys, np.concatenate([p[1] for p in parts]), bits)
            held.clear()
            return _batch(rows, _BLOCK)

        for batch in batches:
            for _, _, raws in _slices(batch.column(0)):
                tokens = Tokens(raws)
                held[1].append(([tokens.lo, tokens.hi], np.bincount(tokens.ids, minlength=len(tokens.lo))))
                for k, (_, keys, which) in enumerate(tokens.grams(order), 2):
                    held[k].append(([keys], np.bincount(which, minlength=len(keys))))
                n += len(tokens.ids)
                if n >= TOKENS:
                    yield told()
                    n = 0
        yield told()

    return counted


def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A segment's part of the filter: as many words of 64 bits as its keys need, at least one."""
    levels = levels_of(counts)
    words = np.zeros(max(1, -(-int(levels.sum()) * BITS // 64)), dtype=np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, mask = _bits(keys[levels >= level], level, np.uint64(len(words)))
        np.bitwise_or.at(words, at.astype(np.int64), mask)
    return words.tobytes()


def _bits(keys: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word that holds (key, level), and its bits there."""
    key = _mix(keys + _LEVEL[level])
    mask = _ONE << (key & np.uint64(63))
    for i in range(1, PROBES):
        mask |= _ONE << ((key >> np.uint64(6 * i)) & np.uint64(63))
    return (key >> np.uint64(32)) % size, mask


class Filter:
    """Parts of the filter by segment, as one run of words; segments that aren't there hold nothing."""

    def __init__(self, parts: Iterable[tuple[int, bytes | memoryview]], bits: int, n_bytes: int):
        self.bits, at = bits, 0
        self.starts, self.sizes, self.words = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint64), np.zeros(n_bytes // 8, dtype=np.uint64)
        for segment, part in parts:
            own = np.frombuffer(part, dtype=np.uint64)
            self.starts[segment], self.sizes[segment] = at, len(own)
            self.words[at : at + len(own)] = own
            at += len(own)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level that each key is held with, 0 for none: levels are probed in turn until one is missing."""
        out = np.zeros(len(keys), dtype=np.uint8)
        of = _segment(keys, self.bits)
        alive = np.flatnonzero(self.sizes[of] > 0)
        own, of, level = keys[alive], of[alive], 1
        while len(alive):
            at, mask = _bits(own, level, self.sizes[of])
            hit = (self.words[self.starts[of] + at] & mask) == mask
            alive, own, of = alive[hit], own[hit], of[hit]
            out[alive] = level
            level += 1
        return out


def _merged(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks sorted by segment and part to one row of words (part 1) and one of the filter (part 0) a segment."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, defaultdict(list)

        def told() -> pa.RecordBatch:
            rows, keys, counts = [], [], []
            for k, blocks in held.items():
                read = [_read(k, b) for b in blocks]
                own, n = _summed([np.concatenate(c) for c in zip(*(r[0] for r in read), strict=True)], np.concatenate([r[1] for r in read]))
                if k == 1:
                    rows.append((at, 1, len(n), int(n.sum()), b"".join([own[0].tobytes(), own[1].tobytes(), n.astype(np.int64).tobytes()])))
                keys.append(own[0])
                counts.append(n)
            part = build(np.concatenate(keys), np.concatenate(counts))
            held.clear()
            return _batch([*rows, (at, 0, len(part), 0, part)], _PART)

        for batch in batches:
            for segment, k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if segment != at and held:
                    yield told()
                at = segment
                held[k].append(block.as_buffer())
        if held:
            yield told()

    return merged


def _words(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(block) // 24
    return np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.uint64, n, 8 * n), np.frombuffer(block, np.int64, n, 16 * n)


@dataclass
class Model:
    """Counts of a corpus: ``parts`` has (segment, part, size, total, block), in the shared folder."""

    parts: DataFrame
    bits: int
    order: int
    n_tokens: int
    n_words: int
    n_bytes: int
    mass: float = MASS
    shares: list = field(default_factory=list)  # broadcasts

    def words(self, least: int | None = None, below: int | None = None) -> DataFrame:
        """(lo, hi, n) of the words that occur ``least`` times or more, or less than ``below`` times."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    lo, hi, n = _words(block)
                    keep = (n >= (least or 0)) & (n < (below or np.iinfo(np.int64).max))
                    yield pa.RecordBatch.from_arrays([pa.array(lo[keep].view(np.int64)), pa.array(hi[keep].view(np.int64)), pa.array(n[keep])], names=["lo", "hi", "n"])

        return self.parts.where("part = 1").select("block").mapInArrow(rows, "lo bigint, hi bigint, n bigint")

    def common(self, most: int = MOST_WORDS) -> int:
        """The least count that at most ``most`` words reach, from a histogram of counts."""

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    got = np.bincount(levels_of(_words(block)[2]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got)), pa.int32()), pa.array(got, pa.int64())], names=["level", "words"])

        bins = self.parts.where("part = 1").select("block").mapInArrow(binned, "level int, words bigint").groupBy("level").agg(F.sum("words").alias("words")).collect()
        total, least = 0, len(_POWERS) - 1
        for row in sorted(bins, key=lambda r: -r.level):
            total += row.words
            if total > most:
                break
            least = row.level - 1
        return int(_POWERS[max(least, 0)])


def fit(texts: DataFrame, order: int = ORDER, mass: float = MASS) -> Model:
    """Counts of all n-grams up to ``order`` in the column ``text`` of every row; a null text is its end only."""
    rows = texts.select(F.col("text").cast("string").cast("binary").alias("raw"))
    n_bytes = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, n_bytes / SEGMENT)))))
    blocks = rows.mapInArrow(_counter(order, bits), "segment int, part int, block binary")
    parts = cut(blocks.repartition(min(1 << bits, MOST_PARTITIONS), "segment").sortWithinPartitions("segment", "part").mapInArrow(_merged(bits), "segment int, part int, size bigint, total bigint, block binary"))
    one = parts.agg(F.sum(F.when(F.col("part") == 1, F.col("total"))).alias("tokens"), F.sum(F.when(F.col("part") == 1, F.col("size"))).alias("words"), F.sum(F.when(F.col("part") == 0, F.col("size"))).alias("bytes")).first()
    return Model(parts, bits, order, one.tokens or 0, one.words or 0, one.bytes or 0, mass)


def probabilities(order_counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], singles: np.ndarray, n_tokens: int, n_words: int, mass: float) -> np.ndarray:
    """p of each token from its own count and (places, count, context's count) of the longer n-grams, shortest first."""
    p = (singles + 1) / (n_tokens + n_words + 1)
    for places, own, context in order_counts:
        context = np.maximum(context, own)
        p[places] = np.where(context > 0, (own + mass * p[places]) / (context + mass), p[places])
    return p


def _summary(ids: np.ndarray, sizes: np.ndarray, word_levels: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], exact: np.ndarray, model: tuple[int, int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base, score) of each text from the levels of its words and of the (places, levels) of longer n-grams; ``exact`` counts below 0 are left to others.

    A context is the n-gram one shorter that ends a token earlier; what ends before a text begins is END.
    """
    n_tokens, n_words, mass = model
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    was = word_levels[ids]
    singles, longer = _MIDDLE[was], []
    for places, own in grams:
        context = np.r_[word_levels[:1], was[:-1]][places]
        longer.append((places, _MIDDLE[own], _MIDDLE[context]))
        was = np.zeros_like(was)
        was[places] = own
    score = np.add.reduceat(np.log10(probabilities(longer, singles, n_tokens, n_words, mass)), starts)
    base = np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 1) / (n_tokens + n_words + 1)), 0.0)
    return np.add.reduceat((exact > 0).astype(np.int64)[ids], starts), np.add.reduceat(base[ids], starts), score


_ASKED = "row_id bigint, doc_id bigint, held_out boolean, raw binary"
_ROW = "row_id bigint, lo bigint, hi bigint, k bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
_ROW_SCHEMA = pa.schema([(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _ROW.split(", "))])


def _doc_rows(ids: list, sizes: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    n = len(sizes)
    columns = [pa.array(ids[0], pa.int64()), pa.array(spread.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, dtype=np.int64)), pa.array(ids[1], pa.int64()), pa.array(ids[2], pa.bool_()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, schema=_ROW_SCHEMA)


def _broadcast_rows(model: Model, docs: DataFrame) -> DataFrame:
    """A row a document, and one for each of its words whose exact count isn't among the common ones."""
    spark = docs.sparkSession
    least = model.common()
    got = model.words(least=least).toArrow()  # at most MOST_WORDS rows
    lo, hi, n = (got.column(c).to_numpy() for c in ("lo", "hi", "n"))
    order = np.argsort(lo.view(np.uint64))
    parts = model.parts.where("part = 0").select("segment", "block").toArrow()  # at most MOST_FILTER bytes
    held = Filter(((s.as_py(), b.as_buffer()) for s, b in zip(parts.column("segment"), parts.column("block"), strict=True)), model.bits, model.n_bytes)
    del parts, got
    shared = spark.sparkContext.broadcast((held, lo.view(np.uint64)[order], hi.view(np.uint64)[order], n[order]))
    model.shares.append(shared)
    numbers, longest = (model.n_tokens, model.n_words, model.mass), model.order

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, keys, checks, counts = shared.value
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(3)]
            for a, b, raws in _slices(batch.column(3)):
                tokens = Tokens(raws)
                levels = filter_.levels(tokens.lo)
                exact = np.where(levels > 0, -1, 0).astype(np.int64)  # what isn't in the filter doesn't occur
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, tokens.lo), len(keys) - 1)
                    hit = (keys[at] == tokens.lo) & (checks[at] == tokens.hi)
                    exact[hit] = counts[at[hit]]
                grams = [(places, filter_.levels(own)[which]) for places, own, which in tokens.grams(longest)]
                known, base, score = _summary(tokens.ids, tokens.sizes, levels, grams, exact, numbers)
                own = [c[a:b] for c in ids]
                yield _doc_rows(own, tokens.sizes, known, base, score, _mix(np.array(own[0], dtype=np.uint64)))
                open_ = np.flatnonzero(exact[tokens.ids] < 0)
                if len(open_):
                    of = np.repeat(np.arange(b - a), tokens.sizes)[open_]
                    pair, k = np.unique(of * len(tokens.lo) + tokens.ids[open_], return_counts=True)
                    of, word = pair // len(tokens.lo), pair % len(tokens.lo)
                    n = len(pair)
                    rows = [pa.array(np.array(own[0], dtype=np.int64)[of]), pa.array(tokens.lo[word].view(np.int64)), pa.array(tokens.hi[word].view(np.int64)), pa.array(k.astype(np.int64)), *(pa.nulls(n, t) for t in _ROW_SCHEMA.types[4:])]
                    yield pa.RecordBatch.from_arrays(rows, schema=_ROW_SCHEMA)

    rows = docs.mapInArrow(scored, _ROW)
    rare = model.words(below=least).withColumnsRenamed({"lo": "word_lo", "hi": "word_hi"})
    return rows.join(rare.hint("merge"), (F.col("lo") == F.col("word_lo")) & (F.col("hi") == F.col("word_hi")), "left")


_SENT = "slice bigint, segment int, part int, block binary"
_SENT_SCHEMA = pa.schema([("slice", pa.int64()), ("segment", pa.int32()), ("part", pa.int32()), ("block", pa.binary())])


def _packed(numbers: np.ndarray) -> tuple[int, str, bytes]:
    """Whole numbers by their bytes' places, compressed: those of small or of ascending numbers hold little."""
    numbers = np.ascontiguousarray(numbers)
    return len(numbers), numbers.dtype.str, pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.dtype.itemsize).T).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: tuple[int, str, bytes]) -> np.ndarray:
    n, kind, data = packed
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T).view(kind).ravel()


def _questions(tokens: Tokens, order: int, bits: int) -> tuple[list[tuple[np.ndarray, int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """The longer n-grams (places, how many, which), all keys, the words' first, their segments, and their order by segment."""
    grams = [*tokens.grams(order)]
    keys = np.concatenate([tokens.lo, *(own for _, own, _ in grams)])
    of = _segment(keys, bits)
    return [(places, len(own), which) for places, own, which in grams], keys, of, np.argsort(of, kind="stable")


def _exchanged_rows(model: Model, docs: DataFrame) -> DataFrame:
    """A row a document, all counts known: questions go to the segments, answers back to the slices of documents that asked.

    ``docs`` is read once for what the slices ask and once for the slices, so neither is written first; a slice has its first row's
    number. They go on as tokens and hashes of words, from which what they asked is made again.
    """
    bits, longest, numbers = model.bits, model.order, (model.n_tokens, model.n_words, model.mass)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list], Tokens]]:
        for batch in batches:
            ids = [batch.column(i).to_pylist() for i in range(3)]
            for a, b, raws in _slices(batch.column(3), ASKING):
                yield ids[0][a], [c[a:b] for c in ids], Tokens(raws)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, tokens in slices(batches):
            _, keys, of, order = _questions(tokens, longest, bits)
            edges = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
            rows = []
            for s, e in zip(edges, np.r_[edges[1:], len(order)], strict=True):
                own = order[s:e]
                words = own[own < len(tokens.lo)]  # these come first
                rows.append((number, int(of[own[0]]), 2, pickle.dumps((_packed(keys[own]), tokens.hi[words].tobytes()))))
            yield _batch(rows, _SENT_SCHEMA)

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, tokens in slices(batches):
            yield _batch([(number, -1, 2, pickle.dumps((ids, _packed(tokens.ids.astype(np.uint32)), _packed(tokens.sizes.astype(np.uint32)), tokens.lo.tobytes())))], _SENT_SCHEMA)

    def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = filter_ = words = None
        for batch in batches:
            rows = []
            for slice_, segment, part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != at:
                    at, filter_, words = segment, None, None
                if part == 0:
                    filter_ = Filter([(segment, block)], bits, len(block))
                elif part == 1:
                    words = _words(block)
                else:
                    keys, hi = pickle.loads(block)
                    keys, hi = _unpacked(keys), np.frombuffer(hi, np.uint64)
                    counts = np.zeros(len(hi), dtype=np.int64)
                    if words is not None and len(hi):
                        first = np.searchsorted(words[0], keys[: len(hi)])
                        for step in range(4):  # words of equal lower hash are neighbours
                            i = np.minimum(first + step, len(words[0]) - 1)
                            hit = (words[0][i] == keys[: len(hi)]) & (words[1][i] == hi)
                            counts[hit] = words[2][i[hit]]
                    levels = filter_.levels(keys) if filter_ is not None else np.zeros(len(keys), dtype=np.uint8)
                    rows.append((slice_, segment, 3, pickle.dumps((levels, counts))))
            yield _batch(rows, _SENT_SCHEMA)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, answers = None, []

        def told() -> pa.RecordBatch:
            ids, of, sizes, lo = asked
            tokens = Tokens.of(_unpacked(of), _unpacked(sizes), np.frombuffer(lo, np.uint64))
            places, _, _, order = _questions(tokens, longest, bits)
            n_words = len(tokens.lo)
            if len(order) != sum(len(a[0]) for a in answers):
                raise RuntimeError("documents were not in the same partitions when they were read again")
            levels = np.zeros(len(order), dtype=np.uint8)
            levels[order] = np.concatenate([a[0] for a in answers])
            exact = np.zeros(n_words, dtype=np.int64)
            exact[order[order < n_words]] = np.concatenate([a[1] for a in answers])
            grams, at = [], n_words
            for where, n, which in places:
                grams.append((where, levels[at : at + n][which]))
                at += n
            known, base, score = _summary(tokens.ids, tokens.sizes, levels[:n_words], grams, exact, numbers)
            return _doc_rows(ids, tokens.sizes, known, base, score, np.zeros(len(tokens.sizes), dtype=np.uint64))

        for batch in batches:
            for _, segment, _, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment < 0:
                    if asked:
                        yield told()
                    asked, answers = pickle.loads(block), []
                else:
                    answers.append(pickle.loads(block))
        if asked:
            yield told()

    held = model.parts.select(F.lit(-1).cast("bigint").alias("slice"), "segment", "part", "block")
    answers = held.unionByName(docs.mapInArrow(asking, _SENT)).repartition(min(1 << bits, MOST_PARTITIONS), "segment").sortWithinPartitions("segment", "part").mapInArrow(answering, _SENT)
    back = docs.mapInArrow(waiting, _SENT).unionByName(answers).repartition("slice").sortWithinPartitions("slice", "segment")
    return back.mapInArrow(gathered, _ROW).withColumn("n", F.lit(None).cast("bigint"))


def log_probabilities(model: Model, docs: DataFrame, held_out: Column, most: int = MOST_FILTER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    asked = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").cast("binary").alias("raw"))
    rows = _broadcast_rows(model, asked) if model.n_bytes <= most else _exchanged_rows(model, asked)
    total = float(model.n_tokens + model.n_words + 1)
    rest = F.when(F.col("k") > 0, F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(total))).otherwise(0.0)
    return rows.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.bool_or("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.coalesce(F.max("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("k"))), F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.coalesce(F.max("base"), F.lit(0.0)) + F.sum(rest)).alias("base_score"), F.max("score").alias("score"),
    ).drop("row_id")


def score(docs: DataFrame, modulus: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """Scores of every whole text, learnt from the rows outside the held-out fold.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text is an empty one: its end is its only token. A row
    without an id is learnt from. Repeated rows count and are scored each. Without rows to learn from every token has
    probability 1. An empty table gives no rows.
    """
    held_out = F.coalesce(fold_of(F.col("doc_id"), modulus) == held, F.lit(False))
    return log_probabilities(fit(docs.where(~held_out), order), docs, held_out)
