import hashlib
import random
import re

import numpy as np
import pytest

from lodestar.llm import repeats


def brute(rows, length):
    """By doc_id, then start: bytes that a window starting earlier covers."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[doc_id] = (len(data), len(data) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(90, 400))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.6 else "".join(rng.choice("xyzü ") for _ in range(rng.randrange(200))) for _ in range(rng.randrange(5))]
        rows.append((i, "".join(parts)))
    rows += [(200, "ab" * 500), (201, "a" * 700), (202, "a" * 99), (203, None), (204, rows[3][1]), (205, "a" * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digest(docs).collect()}
    assert got == brute(rows, 100)


def test_first_of_repeated_rows_stays(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(50)) + "and so on " * 3 + "".join(chr(97 + i * 11 % 26) + str(i) for i in range(80))
    got = repeats.digest(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in got) == [("1", False), ("1", False), ("2", True), ("None", True)]


def test_column_rounds_sort_suffixes():
    rng = random.Random(3)
    contexts = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(40)]
    groups, before = np.zeros(40, dtype=int), np.full(40, 10)
    order, prefix = np.empty(0, np.int64), np.empty(0, np.int64)
    for column in range(29, -1, -1):
        ended = np.flatnonzero(np.full(40, column == 29))
        symbols = np.array([c[column] for c in contexts], dtype=np.uint8)
        order, prefix = repeats.insert_column(order, prefix, ended, groups, symbols, np.ones(40, bool))
        suffixes = [contexts[i][column:] for i in order]
        assert suffixes == sorted(suffixes)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix.tolist() == [-1] + [common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    marked = repeats.repeated_windows(groups, contexts, before, length=6)
    for i, c in enumerate(contexts):
        for back in range(11):
            at = 10 - back
            assert marked[i, back] == any(contexts[j][at : at + 6] == c[at : at + 6] for j in range(i))


def test_parts_of_a_text_share_anchors(monkeypatch):
    rng = random.Random(11)
    texts = [bytes(rng.choice(b"abcdef") for _ in range(n)) for n in (3000, 150, 2500, 90)]
    whole = [a.tolist() for a in repeats.anchors(texts)]
    monkeypatch.setattr(repeats, "SLICE", 400)
    for part in (450, 601, 997):
        monkeypatch.setattr(repeats, "PART", part)
        assert [a.tolist() for a in repeats.anchors(texts)] == whole


@pytest.mark.parametrize("block", [1, 3])
def test_split_grams_equal_brute_force(spark, block):
    rng = random.Random(block)
    line = "this line of more than thirty-two bytes stands in all of them; "
    rows = []
    for i in range(60):
        around = ["".join(rng.choice("ab") for _ in range(rng.choice([5, 40, 90]))) for _ in range(3)]
        rows.append((i, around[0] + line * rng.choice([1, 1, 2]) + around[1] + rng.choice([line[:50], "", line]) + around[2]))
    rows += [(100 + i, r[1]) for i, r in enumerate(rows[:5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    done = repeats.remove(docs, 100, block=block).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept) n", "size(spans) s", "sha2(kept, 256) h")
    assert {r["doc_id"]: tuple(r)[1:] for r in done.collect()} == brute(rows, 100)


def test_memory_of_a_gram_with_very_many_contexts():
    import tracemalloc

    import pyarrow as pa

    def batches(n):
        for lo in range(0, n, 10_000):
            ids = np.arange(lo, lo + 10_000)
            bodies = [b"%07d" % i + b"x" * 60 + b"g" * 32 + b"%06d" % (i % 1000) + b"y" * 60 for i in ids]
            columns = [np.zeros(len(ids), np.int64), ids, np.zeros(len(ids), np.int32), np.full(len(ids), 67), np.zeros(len(ids), np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(ids), pa.int64()), pa.array(bodies, pa.binary()), pa.array(np.zeros(len(ids), np.int32)), pa.array(np.full(len(ids), 68, np.int32))], names=list("abcdefghi"))

    tracemalloc.start()
    made = sum(b.num_rows for b in repeats._sorted_blocks(batches(200_000), 100, 2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 1_600_000 and peak < 60 << 20
