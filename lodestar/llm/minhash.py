"""Near-duplicate groups by a multi-index Hamming join of b-bit minhash signatures.

A document's signature has VALUES minhashes of 16 bits. Signatures that differ
in at most RADIUS values are candidates. The signature is split into CHUNKS; by
the pigeonhole principle two such signatures differ in at most ERRORS values of
some chunk, so each chunk is entered under every choice of ERRORS values left
out, and all pairs within the radius meet in some bucket. Candidates are
confirmed on full shingle sets.

Documents with equal sets are one class from the start, so exact copies never
meet. In a bucket all members are compared with its smallest one first. Where that
leaves several components, each member is compared with the nearest one of
another component, for some rounds, and at last all pairs across components that
are left: no link is lost, and a group that links up never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import bitmap, cut, gather, in_bitmap
from .components import components

WORDS = 5
PERCENT = 75
#: 64 values: a pair at similarity 0.75 differs in 16 on average, with deviation 3.5; more than 31 has probability 1e-5.
VALUES, CHUNKS, ERRORS = 64, 16, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Bits of the sketches that tell, without error, many pairs that can't be similar enough.
SKETCH = 2048
#: Rounds in which each member of a bucket is compared with its nearest one of another component.
ROUNDS = 2
#: Members of a bucket that are compared with each other, or with as many others, in one go; larger buckets are cut into blocks.
TOGETHER = 4096
#: Bytes of text that are hashed at once.
SLICE = 500_000
#: Rows that are unpacked at once, of an Arrow batch.
ROWS = 500

_random = np.random.Generator(np.random.PCG64(20240229))
_odd = lambda n: _random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _PLACE, _GRAM, _FLIP, _TIMES = _odd(256), _odd(1 << 12), _odd(WORDS), _odd(VALUES), _odd(VALUES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    joined = _LOWER[joined]
    space = _SPACE[joined]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in texts]
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    lengths = ends - starts
    at = np.arange(len(joined)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(joined)]])))
    place = _PLACE[at & 0xFFF] + (at >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
    words = np.add.reduceat(np.where(space, np.uint64(0), _BYTE[joined] * place), starts)
    words = _mix(words + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    n = len(words) - WORDS + 1
    grams = _mix(sum(words[k : k + n] * _GRAM[k] for k in range(WORDS))) if n > 0 else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _GRAM[: b - a]).sum(keepdims=True) ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 63-bit number for each set, equal for equal sets."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])[:-1]
    mixed = _mix(flat ^ np.uint64(0xD6E8FEB86659FD93))
    return (_mix(np.add.reduceat(mixed, starts) + np.bitwise_xor.reduceat(flat, starts)) >> np.uint64(1)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of VALUES 16-bit minhashes for each set; as below, no set may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets])[:-1]
    out = np.empty((len(sets), VALUES), dtype=np.uint16)
    for k in range(VALUES):
        y = (flat ^ _FLIP[k]) * _TIMES[k]
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = _mix(np.minimum.reduceat(y, starts)) >> np.uint64(48)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH bits for each set: whether an odd number of its members fall in a cell.

    Two rows differ in at most as many bits as there are members that only one set has.
    """
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(owner * SKETCH + (flat >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=len(sets) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1)


def _opened(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and sketches, as numbers that can be compared."""
    raw = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, 2 * VALUES + SKETCH // 8)
    return np.ascontiguousarray(raw[:, : 2 * VALUES]).view(np.uint16), np.ascontiguousarray(raw[:, 2 * VALUES :]).view(np.uint64)


def _possible(sketch: np.ndarray, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bits in which sketches differ, or -1 where sets of these sizes together can't be similar enough then."""
    bits = np.bitwise_count(sketch ^ others).sum(axis=-1).astype(np.int64)
    return np.where(bits * (100 + percent) <= sizes * (100 - percent), bits, -1)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, class_key, signature); the last two are null for texts without words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                sets = shingle_sets(texts[a:b])
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, signs = [None] * len(sets), [None] * len(sets)
                if full:
                    kept = [sets[i] for i in full]
                    for i, key, sign, sketch in zip(full, set_ids(kept).tolist(), signatures(kept), sketches(kept), strict=True):
                        keys[i], signs[i] = key, sign.tobytes() + sketch.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "class_key", "signature"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary"), text_key(F.col("text"))).mapInArrow(mark, "doc_id bigint, text_key bigint, n_shingles bigint, class_key bigint, signature binary")


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, class_key): each signature's entries, one for each chunk and choice of values left out."""
    width = VALUES // CHUNKS
    choices = [*combinations(range(width), width - ERRORS)]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            signs = _opened(batch.column(1).to_pylist())[0].astype(np.uint64)
            found = np.empty((len(signs), CHUNKS * len(choices)), dtype=np.uint64)
            for c in range(CHUNKS):
                for j, choice in enumerate(choices):
                    key = np.full(len(signs), c * len(choices) + j + 1, dtype=np.uint64)
                    for v in choice:
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signs[:, c * width + v])
                    found[:, c * len(choices) + j] = key
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), found.shape[1]))], names=["bucket", "class_key"])

    return classes.select("class_key", "signature").mapInArrow(enter, "bucket bigint, class_key bigint")


def within_radius(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most RADIUS values and whose sketches don't rule them out."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, u), (y, v) = (_opened(batch.column(k).to_pylist()) for k in (2, 3))
                kept = ((x != y).sum(axis=1) <= RADIUS) & (_possible(u, v, batch.column(4).to_numpy(), percent) >= 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept))

    side = lambda v, s: classes.select(F.col("class_key").alias(v), F.col("signature").alias(s), F.col("n").alias(f"n{s}"))
    return pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb", F.col("nsa") + F.col("nsb")).mapInArrow(close, "a bigint, b bigint")


#: Bits of the filter by which documents are passed over whose classes occur in no pair: 1 MB, whatever the corpus.
FILTER_BITS = 1 << 23


def shingles_of(docs: DataFrame, classes: DataFrame, involved: DataFrame) -> DataFrame:
    """(class_key, shingles) of the ``involved`` classes.

    Texts aren't shuffled: each task makes the sets of its own documents that pass
    a filter of fixed size, and those of the classes that are wanted go on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(involved.join(classes.select("class_key", "rep"), "class_key"), "rep", FILTER_BITS))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(shared.value, batch.column(0).to_numpy())))
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                sets = [s for s in shingle_sets([t or b"" for t in part.column(1).to_pylist()]) if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class_key", "shingles"])

    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(FILTER_BITS))
    sets = docs.select(bit, F.col("text").cast("string").cast("binary")).mapInArrow(sets_of, "class_key bigint, shingles array<bigint>")
    # a class may be several rows
    return gather(sets.join(involved, "class_key", "left_semi").dropDuplicates(["class_key"]), 5_000)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class_key")).union(pairs.select(F.col("b").alias("class_key"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    side = lambda v, s: sets.select(F.col("class_key").alias(v), F.col("shingles").alias(s))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    met = met.withColumn("common", F.size(F.array_intersect("x", "y")))
    return gather(met.where(F.col("common") * 100 >= F.lit(percent) * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"))


def _partners(keys: np.ndarray, roots: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, packed: list[bytes], nearest: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of a bucket's members of different roots that are within the radius and that their sketches don't rule out.

    ``nearest``: only the likeliest one of each member. Else all, each once: small
    components first, against all that follow. Of members of two blocks only
    those of different ones are paired, as others meet elsewhere.
    """
    _, number, counts = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.argsort(counts[number], kind="stable")
    keys, roots, sizes, blocks = keys[order], roots[order], sizes[order], blocks[order]
    apart = bool((blocks != blocks[0]).any())
    signs, sketch = (x[order] for x in _opened(packed))
    n = len(keys) if nearest else len(keys) - int(counts.max())
    for i in range(n):
        first = 0 if nearest else i + 1
        bits = _possible(sketch[i], sketch[first:], sizes[first:] + sizes[i], percent)
        at = np.flatnonzero((bits >= 0) & (roots[first:] != roots[i]) & ((blocks[first:] != blocks[i]) | (not apart)))
        at = at[(signs[i] != signs[first:][at]).sum(axis=1) <= RADIUS]
        if nearest and len(at):
            at = at[[int(np.argmin(bits[at] / (sizes[at] + sizes[i])))]]
        for k in keys[first:][at].tolist():
            yield min(int(keys[i]), k), max(int(keys[i]), k)


def opened(entries: DataFrame, roots: DataFrame, classes: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(bucket, class_key, n, signature, block) of the buckets whose members are of several components.

    A bucket with more than ``together`` members is several: one for each pair of
    its blocks, so that each comparison is of a bounded number of members, and
    those of a large bucket spread over many tasks.
    """
    named = _named(entries, roots)
    several = named.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / together).alias("blocks")).where("least <> most").select("bucket", "blocks")
    rows = named.join(several, "bucket").withColumn("block", F.pmod(F.xxhash64("class_key"), F.col("blocks")))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    to = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")))
    return cut(other.select("class_key", to.alias("bucket"), F.col("block").cast("int").alias("block")).join(classes.select("class_key", "n", "signature"), "class_key").select("bucket", "class_key", "n", "signature", "block"))


def _named(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots, F.col("class_key") == F.col("v"), "left").drop("v").withColumn("root", F.coalesce("root", "class_key"))


def partners(entries: DataFrame, roots: DataFrame, nearest: bool, percent: int) -> DataFrame:
    """Pairs (a, b) within the radius that share a bucket of ``entries`` but not a component, in streams of whole buckets."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        found: set[tuple[int, int]] = set()

        def done(part: pa.Table) -> None:
            if not part.num_rows:
                return
            bucket, keys, own, sizes, blocks = (part.column(k).to_numpy() for k in range(5))
            packed = part.column(5).to_pylist()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (own[a:b] != own[a]).any():
                    found.update(_partners(keys[a:b], own[a:b], sizes[a:b], blocks[a:b], packed[a:b], nearest, percent))

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[-1].as_py()
            first_of_last = int(np.searchsorted(batch.column(0).to_numpy(), last))
            if waiting and waiting[-1].column(0)[0].as_py() == last:  # all of one bucket so far
                waiting.append(batch)
                continue
            done(pa.Table.from_batches([*waiting, batch.slice(0, first_of_last)]))
            waiting = [batch.slice(first_of_last)]
            if len(found) > 100_000:
                yield flushed()
        if waiting:
            done(pa.Table.from_batches(waiting))
        yield flushed()

    rows = _named(entries, roots).select("bucket", "class_key", "root", "n", "block", "signature").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(compared, "a bigint, b bigint").distinct()


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates of a row of smaller id.

    One row of each component stays: that of the smallest id, null last, and of
    rows with this id the one whose text has the smallest hash. Texts without
    words all stay, but of rows equal in id and text only one does.
    """
    found = linked(docs, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    own = F.when(F.col("root").isNull(), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_key")).otherwise(F.col("root").cast("string"))
    name = lambda id, key: F.concat_ws(":", F.coalesce(id.cast("string"), F.lit("null")), key)
    stay = found.groupBy(own.alias("of")).agg(F.min(first).alias("x")).select(name(F.col("x.id"), F.col("x.key")).alias("__stays")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    named = packed.select("row", name(F.col("row.doc_id").cast("bigint"), text_key(F.col("row.text"))).alias("__name"))
    kept = named.join(stay, F.col("__name") == F.col("__stays"), "left_semi")
    return kept.withColumn("__copy", F.row_number().over(Window.partitionBy("__name").orderBy("__name"))).where("__copy = 1").select("row.*")


def group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text, or one
    without words, has no shingles and no links, and is its own component. Rows
    with equal sets are linked. Null ids don't name a component unless all its
    ids are null; rows with a null id in a component that has others aren't
    kept. Rows that repeat the smallest id are all kept. An empty table gives no
    rows.
    """
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = linked(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(docs: DataFrame, percent: int = PERCENT, together: int = TOGETHER) -> DataFrame:
    """(doc_id, text_key, n_shingles, root, component_id) of every row; root, the component's number, is null without shingles."""
    if percent < PERCENT:
        raise ValueError(f"the signatures find similarities from {PERCENT} percent")
    rows = marked(docs).persist(StorageLevel.MEMORY_AND_DISK)  # 400 bytes a document
    classes = rows.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("signature").alias("signature")).persist(StorageLevel.MEMORY_AND_DISK)
    entries = buckets(classes)
    least = entries.groupBy("bucket").agg(F.min("class_key").alias("centre"), F.count("*").alias("members")).where("members > 1").drop("members")
    shared = entries.join(least, "bucket").persist(StorageLevel.MEMORY_AND_DISK)  # buckets with two members or more
    stars = gather(within_radius(shared.where("class_key <> centre").select(F.col("centre").alias("a"), F.col("class_key").alias("b")).distinct(), classes, percent))
    links = confirmed(stars, shingles_of(docs, classes, ends(stars)), percent)
    roots = components(links)
    left = opened(shared.select("bucket", "class_key"), roots, classes, together)
    tested, sets = stars, None
    for nearest in [True] * ROUNDS + [False]:
        pairs = gather(partners(left, roots, nearest, percent).join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        wanted = ends(pairs)
        if sets is not None:  # later rounds add those whose nearest ones had all been tested
            wanted = gather(wanted.join(sets.select("class_key"), "class_key", "left_anti"))
        if sets is None or not wanted.isEmpty():
            new_sets = shingles_of(docs, classes, wanted)
            sets = new_sets if sets is None else sets.union(new_sets)
        new = confirmed(pairs, sets, percent)
        tested = tested.union(pairs)
        if not new.isEmpty():
            links = links.union(new)
            roots = components(links)
    names = classes.join(roots, F.col("class_key") == F.col("v"), "left").select("class_key", F.coalesce("root", "class_key").alias("root"), "rep")
    smallest = names.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = names.join(smallest, "root").select(F.col("class_key").alias("of"), "root", "component_id")
    return rows.join(found, F.col("class_key") == F.col("of"), "left").select("doc_id", "text_key", "n_shingles", "root", "component_id")
