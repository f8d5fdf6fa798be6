"""Removal of byte strings that occur earlier in the corpus, by column-wise suffix sorting.

A string of ``length`` bytes is removed from a document if it also starts
earlier. Every such window has one anchor, chosen by its own bytes: the gram in
it with the least hash (the last of equals). Equal windows have equal anchors at
the same distance, so only contexts of anchors whose gram occurs twice need to
be compared, and only with each other.

The contexts of a block are a collection aligned at their anchors. It is built
column by column from the right: each round inserts one symbol for each context
in front of its last suffix. The new order follows from the old by a stable sort
on the inserted symbol (the Burrows-Wheeler step), and the common prefix of
neighbours is one more than the least of those that lay between them. Columns of
symbols are read from, and orders and common prefixes written to, sequential
files; two columns are held at a time. Suffixes of whole
documents are never sorted across tasks: a corpus has as many rounds as its
longest document has bytes, and this has ``2 * length`` at most.

A gram with more distinct contexts than a block holds is split: windows that
start within some distances of the anchor have more bytes than the gram in
common, so contexts go on once for each of some ranges of distances, under these
bytes, and, where that isn't enough, once for each distance. That leaves whole
windows, which are then equal.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import cut

LENGTH = 100
GRAM = 32
#: Bytes of text whose anchors are found at once, and contexts that are sorted at once.
SLICE, BLOCK = 1 << 20, 1 << 14
#: Bytes that the sequential files of a task may hold in memory: above what a block needs, about 30 MB, so they stay there.
SCRATCH = 1 << 26
#: Rows of an Arrow batch whose repeated grams and contexts are combined.
ROWS = 2000

_times = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.uint64((1 << 24) - 1)
#: Bytes of a text that are searched for anchors at once, at most.
PART = (1 << 24) - 1


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place but the last GRAM - 1."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    n = len(data) - GRAM + 1
    h = x[:n] * _times[0]
    for k in range(1, GRAM // 8):
        h ^= h >> np.uint64(29)
        h += x[8 * k : 8 * k + n] * _times[k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first, last): each text's anchors and the windows that chose them, by their starts.

    A text above 2**24 bytes is cut into parts that overlap by length - 1 bytes.
    """
    found = [[np.empty(0, np.int64)], [np.empty(0, np.uint64)], *([np.empty(0, np.int64)] for _ in range(3))]
    for i, offset, part in _parts(texts, length):
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        grams = _grams(data)
        reach = length - GRAM + 1
        y = (grams & ~_PLACES) | (_PLACES - np.arange(len(grams), dtype=np.uint64))
        step = 1
        while 2 * step <= reach:
            y = np.minimum(y[:-step], y[step:])
            step *= 2
        if reach > step:
            y = np.minimum(y[: -(reach - step)], y[reach - step :])
        chosen = (_PLACES - (y & _PLACES)).astype(np.int64)  # for the window that starts at each place
        sizes = np.array([len(p) for p in part])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(part)), sizes)[: len(chosen)]
        valid = np.arange(len(chosen)) + length <= (starts + sizes)[owner]
        new = valid & np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        # the windows that chose an anchor are neighbours; those of a text end where it has no room
        last = np.minimum(np.concatenate([first[1:], [len(chosen)]]), (starts + sizes - length)[owner[first]] + 1) - 1
        own, base = owner[first], starts[owner[first]]
        for column, values in zip(found, (own + i, grams[chosen[first]], chosen[first] - base + offset, first - base + offset, last - base + offset), strict=True):
            column.append(values)
    text, h, anchor, first, last = (np.concatenate(column) for column in found)
    # windows of two parts of a text that chose one anchor are neighbours too
    edges = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]), [True]])) if len(text) else np.zeros(1, int)
    begin = edges[:-1]
    return text[begin], h[begin], anchor[begin], first[begin], last[edges[1:] - 1]


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(number of the first text, offset in it, texts) of runs of about SLICE bytes; texts too short for a window come along."""
    i, most = 0, PART
    while i < len(texts):
        if len(texts[i]) > SLICE:
            for offset in range(0, max(1, len(texts[i]) - length + 1), most - length):
                yield i, offset, [texts[i][offset : offset + most]]
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SLICE:
            size += len(texts[j])
            j += 1
        if size >= length:
            yield i, 0, texts[i:j]
        i = j


def repeated_windows(groups: np.ndarray, contexts: list[bytes], before: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each context and distance before the anchor, whether that window occurs in an earlier context of its group.

    ``groups`` numbers the contexts' anchors and doesn't fall; contexts of a group
    are in the order of the corpus; ``before`` is the bytes a context has before
    its anchor. Windows are those of ``length`` bytes that lie in the context.
    """
    m = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    left, right = int(before.max()), int((sizes - before).max())
    marked = np.zeros((m, left + 1), dtype=bool)
    with tempfile.SpooledTemporaryFile(SCRATCH) as symbols, tempfile.SpooledTemporaryFile(SCRATCH) as built:
        # columns from the last to the first, each a byte for every context
        width = left + right
        for lo in range(0, m, 1024):
            rows = np.zeros((min(1024, m - lo), width), dtype=np.uint8)
            for r, (c, b) in enumerate(zip(contexts[lo : lo + 1024], before[lo : lo + 1024], strict=True)):
                rows[r, left - b : left - b + len(c)] = np.frombuffer(c, dtype=np.uint8)
            symbols.write(np.ascontiguousarray(rows.T[::-1]).tobytes())
        starts, ends = left - before, left - before + sizes
        order, prefix = np.empty(0, np.int64), np.empty(0, np.int64)
        for k, column in enumerate(range(width - 1, -1, -1)):
            pieces = []
            for lo in range(0, m, 1024):
                n = min(1024, m - lo)
                symbols.seek(lo * width + k * n)
                pieces.append(np.frombuffer(symbols.read(n), dtype=np.uint8))
            symbol = np.concatenate(pieces)
            order, prefix = insert_column(order, prefix, np.flatnonzero(ends == column + 1), groups, symbol, starts <= column)
            if column <= left:  # here a window may start
                built.write(np.array([column, len(order)], dtype=np.int64).tobytes() + order.tobytes() + prefix.tobytes())
        built.seek(0)
        while head := built.read(16):
            column, n = np.frombuffer(head, dtype=np.int64)
            order, prefix = np.frombuffer(built.read(8 * n), np.int64), np.frombuffer(built.read(8 * n), np.int64)
            if n:
                heads = np.flatnonzero(prefix < length)  # each begins a run of equal windows
                earliest = np.minimum.reduceat(order, heads)
                later = order != np.repeat(earliest, np.diff(np.concatenate([heads, [n]])))
                marked[order[later], left - column] = True
    return marked


def insert_column(order: np.ndarray, prefix: np.ndarray, ended: np.ndarray, groups: np.ndarray, symbol: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Insert one symbol for each context: (order, prefix) of the suffixes that start one column further left.

    ``order`` has the contexts by group and suffix, ``prefix`` what each shares
    with the one before it (-1 at the head of a group). ``ended`` are contexts
    whose last symbol is this one: their suffixes were empty and sort first.
    """
    # empty suffixes in front of their groups
    joined = np.concatenate([ended, order])
    shared = np.concatenate([np.zeros(len(ended), np.int64), prefix])
    by_group = np.argsort(groups[joined], kind="stable")
    joined, shared = joined[by_group], shared[by_group]
    g = groups[joined]
    inner = np.concatenate([[False], g[1:] == g[:-1]]) if len(g) else np.empty(0, bool)
    shared = np.where(inner, np.maximum(shared, 0), -1)
    # the Burrows-Wheeler step: a stable sort by symbol within each group
    kept = np.flatnonzero(running[joined])
    at = kept[np.argsort(g[kept] * 256 + symbol[joined[kept]], kind="stable")]
    new, key = joined[at], g[at] * 256 + symbol[joined[at]]
    out = np.where(np.concatenate([[False], g[at][1:] == g[at][:-1]]), 0, -1) if len(at) else np.empty(0, np.int64)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    if len(same):  # neighbours that got the same symbol: the least common prefix between them, and one more
        spans = np.column_stack([at[same - 1] + 1, at[same] + 1]).ravel()
        out[same] = 1 + np.minimum.reduceat(np.append(shared, 0), spans)[::2]
    return new, out


#: Windows in their context, from ``near`` to ``far`` bytes before an anchor (all that have its gram, if not said); without a context, a span of repeated ones from first to stop.
CONTEXTS = "part bigint, id bigint, version int, anchor bigint, first bigint, stop bigint, context binary"
RANGED = f"{CONTEXTS}, near int, far int"
_CONTEXTS = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("version", pa.int32()), ("anchor", pa.int64()), ("first", pa.int64()), ("stop", pa.int64()), ("context", pa.binary())])
_RANGED = pa.schema([*_CONTEXTS, ("near", pa.int32()), ("far", pa.int32())])
#: Ranges of distances that a gram with too many contexts is split into first.
RANGES = 8


def _ranges(part: int, near: int, far: int, pieces: int, anchor: int, first: int, context: bytes, length: int) -> Iterator[tuple]:
    """(part, near, far, first, context) of a context whose windows start near to far bytes before its anchor, for each of ``pieces`` ranges of these."""
    step = -(-(far - near + 1) // pieces)
    for a in range(near, far + 1, step):
        b = min(far, a + step - 1)
        begin, end = max(first, anchor - b), min(first + len(context), anchor - a + length)  # the context has windows from begin to end - length
        if end - begin >= length:
            shared = context[anchor - a - first : anchor - b + length - first]  # what all these windows have
            key = hashlib.blake2b(b"%d %d %d " % (part, a, b) + shared, digest_size=8).digest()
            yield int.from_bytes(key, "little", signed=True), a, b, begin, context[begin - first : end - first]


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int, block: int = BLOCK, pieces: int = RANGES, split_only: bool | None = None) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from contexts that come sorted by part (their gram, or what stands for it), document and place.

    Rows of CONTEXTS or RANGED come in, of RANGED go out; a span is one without a context. A context
    equal to an earlier one of its part, which a dictionary knows, is all
    repeated and needs no sorting. Those of a part with more than ``block``
    distinct ones go on in ``pieces`` ranges, so memory holds at most two blocks.
    ``split_only``: only these, for which nothing is sorted, or else only spans.
    """
    rows, known, part, number, was, split = [], {}, None, -1, None, False
    out: list[tuple] = []

    def told() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_RANGED), _RANGED, strict=True)], schema=_RANGED)
        out.clear()
        return batch

    def found(doc: int, version: int, start: int, stop: int) -> None:
        if not split_only:
            out.append((hash((doc, start)), doc, version, start, start, stop, None, 0, 0))

    def go_on(h: int, doc: int, version: int, near: int, far: int, anchor: int, first: int, context: bytes) -> None:
        for to, a, b, begin, body in () if split_only is False else _ranges(h, near, far, pieces, anchor, first, context, length):
            out.append((to, doc, version, anchor, begin, None, body, a, b))

    def flushed() -> pa.RecordBatch:
        if split_only:
            rows.clear()
        if rows:
            groups, before = np.array([r[0] for r in rows]), np.array([r[4] - r[5] for r in rows])
            marked = repeated_windows(groups, [r[3] for r in rows], before, length)
            edge = np.diff(np.pad(marked[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
            left = marked.shape[1] - 1
            for (r, a), (_, b) in zip(np.argwhere(edge == 1), np.argwhere(edge == -1), strict=True):
                first = rows[r][4] - left  # the place of column 0
                found(rows[r][1], rows[r][2], int(first + a), int(first + b - 1 + length))
            rows.clear()
        return told()

    for batch in batches:
        if batch.num_columns == len(_CONTEXTS):
            whole = [pa.array(np.full(batch.num_rows, n, np.int32)) for n in (0, length - GRAM)]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *whole], schema=_RANGED)
        if split_only:
            batch = batch.filter(pc.is_valid(batch.column(6)))
        for h, doc, version, anchor, first, stop, context, near, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if context is None:
                found(doc, version, first, stop)
                if len(out) >= block:
                    yield told()
                continue
            if h != part:
                part, number, known, split = h, number + 1, {}, False
                if len(rows) >= block:
                    yield flushed()
            if (h, doc, version, anchor) == was:  # a row that occurs twice
                continue
            was = (h, doc, version, anchor)
            if split:
                go_on(h, doc, version, near, far, anchor, first, context)
            elif (key := (anchor - first, context)) in known:
                found(doc, version, first, first + len(context))
            elif len(known) >= block and far > near:
                split = True
                for of, *row in rows:
                    if of == number:
                        go_on(h, row[0], row[1], near, far, row[3], row[4], row[2])
                rows[:] = [r for r in rows if r[0] != number]
                go_on(h, doc, version, near, far, anchor, first, context)
            else:
                known[key] = True
                rows.append((number, doc, version, context, anchor, first))
            if len(out) >= block:
                yield told()
    yield flushed()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column compressed, for the shuffle that brings the texts together."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        packed = pa.array([None if t is None else compress(t) for t in batch.columns[-1].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


def _unpack(column: pa.Array) -> list[bytes | None]:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress
    return [None if t is None else plain(t) for t in column.to_pylist()]


def _spread(ids: np.ndarray, versions: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Numbers that deal rows out evenly and alike at every run."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + versions.astype(np.uint64) + (anchor.astype(np.uint64) << np.uint64(20))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _anchor_rows(length: int):
    """Rows (gram, id, version, anchor, many). Of a gram that a batch has several times one row goes on under it,
    marked; the others are known to be repeated and are dealt out under numbers of their own."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            text, h, anchor, _, _ = anchors([t or b"" for t in _unpack(batch.column(2))], length)
            if not len(h):
                continue
            ids, versions = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text]
            _, first, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            many = counts[inverse] > 1
            aside = many & (first[inverse] != np.arange(len(h)))
            gram = np.where(aside, _spread(ids, versions, anchor), h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids), pa.array(versions), pa.array(anchor), pa.array(many)], names=["gram", "id", "version", "anchor", "many"])

    return listed


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by gram, that are marked or whose gram another row has; the last row waits for the next batch."""
    waiting, was_twice = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks().to_batches()[0]
        h, n = table.column(0).to_numpy(), table.num_rows
        same = h[1:] == h[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | table.column(4).to_numpy(zero_copy_only=False)
        twice[0] |= was_twice
        yield table.slice(0, n - 1).filter(pa.array(twice[:-1])).select(["id", "version", "anchor"])
        waiting, was_twice = table.slice(n - 1), bool(twice[-1])
    if waiting is not None and was_twice:
        yield waiting.select(["id", "version", "anchor"])




def _context_rows(length: int):
    """Rows of CONTEXTS. Of equal contexts of a batch the earliest goes on whole, dealt out by its gram; the others are
    repeated for certain and go on as spans up to ``stop``, dealt out evenly."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [t or b"" for t in _unpack(batch.column(2))]
            text, h, anchor, first, last = anchors(texts, length)
            lists = batch.column(3)
            flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            kept = np.flatnonzero(np.isin(text << 40 | anchor, owner << 40 | flat))
            kept = kept[np.lexsort((anchor[kept], versions[text[kept]], ids[text[kept]]))]
            known: set[tuple] = set()
            bodies: list[bytes | None] = []
            for g, t, a, b, at in zip(h[kept].tolist(), text[kept].tolist(), first[kept].tolist(), last[kept].tolist(), anchor[kept].tolist(), strict=True):
                body = texts[t][a : b + length]
                key = (g, at - a, hashlib.blake2b(body, digest_size=16).digest())
                bodies.append(None if key in known else body)
                known.add(key)
            # rows that are equal in id, version and anchor are one place, which isn't its own repeat
            place = np.stack([ids[text[kept]], versions[text[kept]].astype(np.int64), anchor[kept]])
            again = np.concatenate([[False], (place[:, 1:] == place[:, :-1]).all(axis=0)]) if len(kept) else np.empty(0, bool)
            aside = np.array([b is None for b in bodies], dtype=bool)
            own_ids, own_versions, own_anchor = ids[text[kept]], versions[text[kept]], anchor[kept]
            part = np.where(aside, _spread(own_ids, own_versions, own_anchor), h[kept].view(np.int64))
            stop = pa.array(last[kept] + length, mask=~aside)
            out = pa.RecordBatch.from_arrays([*map(pa.array, (part, own_ids, own_versions, own_anchor, first[kept])), stop, pa.array(bodies, pa.binary())], schema=_CONTEXTS)
            yield out.filter(pa.array(~again))

    return listed


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _repeated(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """(id, version, start, stop): spans of repeated windows from CONTEXTS.

    Three passes: over grams, over the ranges of those with too many contexts,
    over single distances. Each pass reads its shuffled rows twice, for spans and
    for what goes on, so spans aren't shuffled from pass to pass; all is one plan.
    """
    passes = []
    for pieces in (RANGES, length, 1):
        dealt = contexts.repartition("part").sortWithinPartitions("part", "id", "version", "anchor")
        spans, contexts = (dealt.mapInArrow(lambda batches, pieces=pieces, only=only: _sorted_blocks(batches, length, block, pieces, only), RANGED) for only in (False, True))
        passes.append(spans.select("id", "version", F.col("first").alias("start"), "stop"))
    return reduce(DataFrame.unionAll, passes)


def remove(docs: DataFrame, length: int = LENGTH, as_text: bool = False, block: int = BLOCK) -> DataFrame:
    """Columns of ``docs`` but text, with n_bytes, spans (array of start, stop in bytes) and kept (the bytes that stay).

    With ``as_text``, kept is a string, without the bytes of characters that were
    cut in two, and null where the text is; else a null text counts as empty.
    Documents are ordered by doc_id, null last and equal to the greatest number,
    rows with one id by a hash of their text; rows equal in both are one
    document and get the same result, so the first of several is not removed by
    its own repeats. Copies of a whole text are known by a 128-bit hash and go
    as a whole, if they have ``length`` bytes. Columns with the names of the new
    ones are replaced; others may have any name. An empty table gives no rows.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be above {GRAM}")
    own = [c for c in docs.columns if c not in ("text", "n_bytes", "spans", "kept")]
    packed = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("bigint").alias("doc"), F.col("text").cast("string").alias("body"))
    # ids and hashes without nulls, so that one partitioning serves all joins
    named = packed.select(F.coalesce("doc", F.lit(2**63 - 1)).alias("id"), F.xxhash64("body").alias("k0"), F.xxhash64(F.lit(1), "body").alias("k1"), F.col("body").cast("binary").alias("body"), "row")
    # of each distinct row the version of its id, and whether a smaller id has the text
    ids = named.groupBy("id", "k0", "k1").agg(F.lit(1).alias("one")).drop("one")
    heads = ids.groupBy(F.col("k0").alias("h0"), F.col("k1").alias("h1")).agg(F.min("id").alias("head"))
    ids = ids.join(heads, (F.col("k0") == F.col("h0")) & (F.col("k1") == F.col("h1"))).groupBy("id", "k0").agg(F.min(F.col("id") != F.col("head")).alias("copy"))
    ids = cut(ids.withColumn("version", F.dense_rank().over(Window.partitionBy("id").orderBy("k0")).cast("int")))  # 21 bytes a document
    # one shuffle of the texts, which the three uses below share
    unpacked = named.select("id", "k0", "row", "body")
    texts = unpacked.mapInArrow(_pack, unpacked.schema).repartition("id", "k0")
    known = ids.select("id", "k0", "copy", "version").hint("shuffle_hash")
    joined = texts.join(known, ["id", "k0"])
    # ``row`` goes along unread, and short texts too: with other columns or rows this would be another shuffle of the texts
    heads_only = joined.where(~F.col("copy")).select("id", "k0", "version", "body", "row")
    found = heads_only.select("id", "version", "body", "row").mapInArrow(_anchor_rows(length), "gram bigint, id bigint, version int, anchor bigint, many boolean")
    twice = found.repartition("gram").sortWithinPartitions("gram").mapInArrow(_twice, "id bigint, version int, anchor bigint")
    numbers = ids.select("id", "version", "k0")
    lists = twice.groupBy("id", "version").agg(F.collect_set("anchor").alias("anchors")).join(numbers, ["id", "version"]).select("id", "k0", "anchors").hint("shuffle_hash")
    contexts = heads_only.join(lists, ["id", "k0"]).select("id", "version", "body", "anchors", "row")
    contexts = contexts.mapInArrow(_context_rows(length), CONTEXTS)
    spans = _repeated(contexts, length, block)
    spans = spans.groupBy("id", "version").agg(F.collect_set(F.struct("start", "stop")).alias("found")).join(numbers, ["id", "version"]).select("id", "k0", "found").hint("shuffle_hash")
    everything = joined.join(spans, ["id", "k0"], "left").select("row", "body", "copy", "found")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            sizes, all_spans, all_kept = [], [], []
            for body, copy, found in zip(_unpack(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = body or b""
                spans = [(0, len(text))] if copy and len(text) >= length else merged([(s["start"], s["stop"]) for s in found or ()])
                places = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
                sizes.append(len(text))
                all_spans.append([{"start": a, "stop": b} for a, b in spans])
                all_kept.append(kept if not as_text else None if body is None else kept.decode(errors="ignore"))
            spanned = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, spanned), pa.array(all_kept, pa.string() if as_text else pa.binary())], names=["row", "n_bytes", "spans", "kept"])

    spanned = ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())]))
    schema = StructType([everything.schema["row"], StructField("n_bytes", LongType()), StructField("spans", spanned), StructField("kept", StringType() if as_text else BinaryType())])
    return everything.mapInArrow(cut_out, schema).select("row.*", "n_bytes", "spans", "kept")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    done = remove(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), length)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
