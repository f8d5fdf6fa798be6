"""Online best-fit packing of token sequences with a bounded number of open bins.

Documents are read once and never shuffled. Each task packs the pieces of its
own input split in their order. Pieces go on when their bin closes, so memory
holds one Arrow batch and the pieces of ``open_bins`` bins whatever the input's
size. Bins that are still open at a split's end are emptied: their pieces, some
numbers each, are packed again together with those of other splits, some of them
at a time, longest first. Bins are numbered by task, so a task that runs again after a lost
executor gives the same numbers.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 1024
OPEN_BINS = 2048
#: Splits whose last bins are packed again together, and how many of these pieces are placed at a time, longest first:
#: about as many as there are open bins, as beyond that long pieces close bins that the short ones need.
TOGETHER, TAIL = 256, 2000
#: Documents whose pieces go on together.
ROWS = 1000
END_ID = 2
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


class OpenBins:
    """Online best fit over at most ``limit`` open bins.

    ``mask`` has bit f set while some open bin has f tokens free, so the
    tightest bin that takes a piece is the lowest set bit at or above its
    length. When a new bin would exceed the limit, the fullest one closes.
    ``closed`` has the numbers of bins that take nothing more.
    """

    def __init__(self, capacity: int, limit: int, first_id: int = 0):
        self.capacity, self.limit, self.next_id = capacity, limit, first_id
        self.mask, self.open, self.bins = 0, 0, [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of ``length`` tokens, 1 to capacity."""
        if fits := self.mask >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number, self.next_id = self.capacity, self.next_id, self.next_id + 1
        if left := free - length:
            if self.open == self.limit:
                fullest = (self.mask & -self.mask).bit_length() - 1
                if fullest >= left:  # the bin just filled is the fullest itself
                    self.closed.append(number)
                    return number, self.capacity - free
                self.closed.append(self._take(fullest))
            self.bins[left].append(number)
            self.mask |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.capacity - free


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder of a byte-level BPE given as a rank file.

    The ranks are the vocabulary of ``byte_bpe_50k.json`` and give the same ids
    at several times the speed; tests hold both against each other.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, preceded by what is over."""
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text is an
    empty one and gives the end token alone; a null doc_id stays null. Rows that
    repeat are packed as often as they occur. Only documents above the capacity
    are cut, into full pieces preceded by a shorter one, so that each cut
    document has one piece to fit. An empty table gives no rows. Pieces are
    placed in the order of the rows of a split; where repeated rows or ties go
    follows from that order. Ids come from the rank file, see encoder().
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    marked = ARROW.append(pa.field("open", pa.bool_()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        waiting: dict[int, list[tuple]] = {}
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or "", disallowed_special=()), end_id).astype("<u4")
                raw = ids.tobytes()
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    number, offset = bins.place(n)
                    waiting.setdefault(number, []).append((doc_id, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), number, offset, False))
                    for done in bins.closed:
                        out += waiting.pop(done)
                    bins.closed.clear()
            yield _batch(out, marked)
        yield _batch([(*row[:-1], True) for rows in waiting.values() for row in rows], marked)

    def packed_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, split = None, None
        rows: list[tuple] = []

        def placed() -> pa.RecordBatch:
            out = [(*row, *bins.place(row[3])) for row in sorted(rows, key=lambda r: -r[3])]
            rows.clear()
            bins.closed.clear()
            return _batch(out, ARROW)

        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != split or len(rows) == TAIL:
                    if rows:
                        yield placed()
                    if part != split:
                        bins, split = OpenBins(capacity, open_bins, (1 << 62) | (part << 40)), part
                rows.append(tuple(row[:5]))
        if rows:
            yield placed()

    first = cut(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(packed, f"{SCHEMA}, open boolean"))  # some numbers a piece
    left = first.where("open").select(F.expr(f"shiftright(sequence_id, 40) div {TOGETHER}").alias("part"), *ARROW.names)
    again = left.repartition("part").sortWithinPartitions("part", "sequence_id", "offset").mapInArrow(packed_again, SCHEMA)
    return first.where("not open").select(*ARROW.names).union(again)
