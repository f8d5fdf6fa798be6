"""Mixing, packing, SimHash, WARC, images, the pipeline."""

import gzip
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import images, mixing, packing, simhash, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fill(sizes, weights, share, cap):
    """Targets by the contract's own words: give by weight, cap, share the excess again."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.remove(i)
    return out


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    names = sorted(set(source.values()))
    by = {s: [r for r in rows if source[r["doc_id"]] == s] for s in names}
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, size, target in zip(names, sizes, want, strict=True):
        assert {r["source_size"] for r in by[s]} == {size}
        assert all(abs(r["target"] - target) < 1e-6 * target for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s]) / 2 + 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in by[s])
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    counts = {r["doc_id"]: r["size"] for r in rows}
    for r in docs.collect():
        assert counts[r["doc_id"]] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))


def test_pack(docs):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    bins = {}
    for r in docs.collect():
        ids = np.array([*reference.encode(r["text"], add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k, p in enumerate(sorted(pieces.pop(r["doc_id"]), key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            assert p["length"] == 1024 or k == 0
            at += p["length"]
            bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert at == len(ids)
    assert not pieces
    for places in bins.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 1024
    total = sum(n for places in bins.values() for _, n in places)
    assert len(bins) <= 1.01 * total / 1024 + 1


def test_open_bins_are_bounded_and_best_fit():
    rng = random.Random(1)
    bins, free = packing.OpenBins(100, 5), {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        still = {k: f for k, f in free.items() if k in {b for own in bins.bins for b in own}}
        assert bins.open == len(still) <= 5
        number, offset = bins.place(n)
        fits = [f for f in still.values() if f >= n]
        if fits:
            assert 100 - offset == min(fits)
        else:
            assert offset == 0 and number not in free
        free[number] = 100 - offset - n


def test_tokens_of_odd_texts():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_to_numpy
    for text in ("", " ", "a<|endoftext|>b", "\n\n  x", "é​\U0001f600 don't I'LL", "  lead", "\x00\x7f", "a" * 3000, " " * 500):
        assert encode(text, disallowed_special=()).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_tokens_of_all_characters():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_to_numpy
    points = [chr(c) for c in [*range(0x800), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0xD7FF, 0xE000, 0xFEFF, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    texts = [*points, *(f"a{c}b {c}{c} c" for c in points), "".join(points), "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "'S 's 'LL I'd", "1234567890" * 9, "\r\n\t \x0b\x0c\x85\xa0\u3000 z"]
    for text in texts:
        assert encode(text, disallowed_special=()).tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("splits", [1, 7, 64])
def test_pack_into_few_sequences(docs, splits):
    rows = packing.pack(docs.repartition(splits)).select("length", "sequence_id").collect()
    ideal = -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert len({r["sequence_id"] for r in rows}) <= 1.005 * ideal


def test_pack_odd_rows(spark):
    texts = [(1, None), (1, None), (2, ""), (None, "null id"), (3, "word " * 5000), (3, "word " * 5000), *((10 + i, "tie") for i in range(40))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("piece", "open", "sequence_id", "part", "offset")}).repartition(3)
    rows = packing.pack(docs).collect()
    assert sum(r["doc_id"] in (1, 2) and r["length"] == 1 for r in rows) == 3 and sum(r["doc_id"] is None for r in rows) == 1
    long = sorted(r["start"] for r in rows if r["doc_id"] == 3)
    assert long[::2] == long[1::2] and sum(r["length"] for r in rows if r["doc_id"] == 3) == 2 * (max(long) + 1024)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    names = [None, *(f"host{rng.randrange(10**6)}.é" for _ in range(400))]
    sizes = {n: rng.choice([0, 1, 10, 1000, rng.randrange(10**6)]) for n in names}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([*sizes.items()], "source string, source_size bigint")).collect()}
    order = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    want = fill([sizes[n] for n in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    assert all(abs(got[n] - t) <= 1e-6 * max(1, t) for n, t in zip(order, want, strict=True))


def test_simhash_edits(docs):
    rows = sorted(simhash.compare(docs).collect())
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    for i, r in enumerate(rows):
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(texts)][:half]
        assert hashlib.sha256(changed.encode()).hexdigest() == r["edited_sha256"] and r["n_chars"] == len(texts[i])
        apart = bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1")
        assert r["near_edited"] == 1 - apart / simhash.BITS
        after = bin(int(r["fingerprint"], 16) ^ int(rows[(i + 1) % len(rows)]["fingerprint"], 16)).count("1")
        assert r["near_next"] == 1 - after / simhash.BITS
        near = sum(bin(int(r["fingerprint"], 16) ^ int(o["fingerprint"], 16)).count("1") <= 6 for o in rows)
        assert r["n_within"] == (near if r["doc_id"] % 50 == 0 else None)


def test_simhash_edits_with_as_many_buckets_as_rows(docs, monkeypatch):
    want = sorted(simhash.compare(docs, every=0).collect())
    monkeypatch.setattr(simhash, "enough_buckets", lambda rows: 30_000)
    assert sorted(simhash.compare(docs, every=0).collect()) == want


def test_simhash_search_is_complete(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(1, 10))) for b in base for _ in range(5)] + base[:3]
    marked = spark.createDataFrame([(i, signed(p & (2**64 - 1)), signed(p >> 64)) for i, p in enumerate(prints)], "doc_id bigint, f0 bigint, f1 bigint")
    got = {(r["query"], r["class_id"], r["bits"]) for r in simhash.search(marked.where("doc_id < 40"), marked, "doc_id").collect()}
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, i)
    want = {(i, j, bin(prints[i] ^ p).count("1")) for i in range(40) for p, j in first.items() if bin(prints[i] ^ p).count("1") <= 6}
    assert got == want


def shuffled_rows(spark):
    """Rows that all stages of the session wrote to shuffles so far, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_simhash_search_shuffles_few_rows_where_queries_are_not_broadcast(spark):
    marked = spark.range(20_000).select(F.col("id").alias("doc_id"), *(F.xxhash64(F.lit(k), "id").alias(f"f{k}") for k in range(2)))
    queries = marked.where("doc_id % 50 = 0").withColumn("f0", F.col("f0").bitwiseXOR(F.shiftleft(F.lit(1).cast("bigint"), 63)))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        got = sorted((r["query"], r["class_id"], r["members"], r["bits"]) for r in simhash.search(queries, marked, "doc_id").collect())
        after = shuffled_rows(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert got == [(i, i, 1, 1) for i in range(0, 20_000, 50)]
    # each print once by classes(), the queries in 28 tables for the filter and the join, and what the filter lets by; not each print in 28 tables
    assert sum(n for stage, n in after.items() if stage not in before) < 3 * 20_000 + 28 * 400


def test_simhash_filter_loses_nothing_when_full(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FILTER_BITS", 1 << 15)  # a few rows, about half of their cells taken
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("front"))
    asked = rows.where("id % 2 = 0")
    kept = {r["id"] for r in simhash.in_filter(rows, simhash.front_filter(asked)).collect()}
    cells = {r["c"] for r in asked.select(F.pmod("front", F.lit(1 << 15)).alias("c")).collect()}
    assert kept == {r["id"] for r in rows.withColumn("c", F.pmod("front", F.lit(1 << 15))).collect() if r["c"] in cells}
    assert simhash.in_filter(rows, simhash.front_filter(asked.where("false"))).count() == 0


def test_warc_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = sorted(con.execute(f"select record_id, url, refers_to, resolved, reason, headers, body_sha256 from ({warc.REVISITS_SQL})").fetchall(), key=str)
    assert sorted(map(tuple, warc.revisits(spark.read.parquet(f"{SF}/pages.parquet")).collect()), key=str) == want


def test_warc_cases(spark):
    rows = [
        ("a", "response", "http://WWW.x.org:80/p?b=2&a=1#f", 10, 200, {"etag": '"1"', "content-type": "text/html", "cache-control": "a"}, b"one"),
        ("b", "response", "https://x.org/p/?a=1&b=2", 20, 200, {"etag": '"2"', "last-modified": "then"}, b"two"),
        ("c", "response", "https://x.org/p?a=1&b=2", 25, 500, {}, b"bad"),
        ("r1", "revisit", "http://x.org/p?a=1&b=2", 15, 304, {"etag": 'W/"1"', "content-type": "no", "cache-control": "b", "expires": "0"}, None),
        ("r2", "revisit", "http://x.org/p?a=1&b=2", 30, 304, {"last-modified": "then"}, None),
        ("r3", "revisit", "http://x.org/p?a=1&b=2", 30, 304, {"etag": '"9"'}, None),
        ("r4", "revisit", "http://x.org/p?a=1&b=2", 10, 304, {"etag": '"1"'}, None),
        ("r5", "revisit", "http://x.org/p?a=1&b=2", 30, 304, {}, None),
        ("r6", "revisit", None, 30, 304, None, None),
        ("r7", "revisit", "http://x.org/p?a=1&b=2", None, 304, {"etag": '"2"'}, None),
    ]
    records = spark.createDataFrame(rows, warc.SCHEMA).withColumn("url", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = {r["record_id"]: r for r in warc.resolve(records).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"r1": "resolved", "r2": "resolved", "r3": "validator mismatch", "r4": "no earlier response", "r5": "no validator", "r6": "no earlier response", "r7": "no earlier response"}
    assert got["r1"]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "b", "expires": "0"} and bytes(got["r1"]["body"]) == b"one"
    assert got["r2"]["refers_to"] == "b" and got["r3"]["body"] is None
    assert warc.resolve(records.where("false")).collect() == []


def test_warc_files(spark, tmp_path):
    def record(kind, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: http://x.org/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    both = [record("warcinfo", b"x"), record("response", b'HTTP/1.1 200 OK\r\nETag: "1"\r\n\r\nbody\r\n\r\nmore'), record("revisit", b'HTTP/1.1 304 Not Modified\r\nETag: "1"\r\n\r\n')]
    (tmp_path / "a.warc").write_bytes(b"".join(both))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, both)))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r["kind"], r["status"], bytes(r["body"])) for r in rows) == [("response", 200, b"body\r\n\r\nmore")] * 2 + [("revisit", 304, b"")] * 2
    assert {r["ts"] for r in rows} == {1704067200} and rows[0]["headers"]["etag"] == '"1"'


@pytest.mark.parametrize("length", ["-500", "abc", "", "99999999999", "1e3", "²"])
def test_warc_with_bad_lengths(length):
    def record(n, block):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{len(block)}>\r\nWARC-Date: junk\r\nContent-Length: {n}\r\n\r\n".encode() + block + b"\r\n\r\n"

    first, last = b"HTTP/1.1 200 OK\r\n\r\nfirst", b"HTTP/1.1 xyz\r\n\r\nthe last"
    rows = [*warc.parse(record(len(first), first) + record(length, b"HTTP/1.1 200 OK\r\n\r\nbad") + record(len(last), last))]
    bodies = [bytes(r[6]) for r in rows]
    assert bodies == ([b"first"] if length == "99999999999" else [b"first", b"the last"]) and rows[0][3] is None and rows[-1][4] in (200, None)


def test_warc_members_take_linear_time():
    import time

    rng = random.Random(1)
    block = rng.randbytes(15_000)
    head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    data = gzip.compress(head + block + b"\r\n\r\n") * 1400
    began = time.time()
    assert len(data) > 20_000_000 and sum(1 for _ in warc.parse(data)) == 1400
    assert time.time() - began < 10
    assert sum(1 for _ in warc.parse(data[:-100])) == 1399 and [*warc.parse(b"\x1f\x8bjunk")] == []


def test_warc_hot_and_repeated_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARED", 3)
    rows = [("a", "response", "http://x.org/p", 10, 200, {"etag": '"1"'}, b"one"), ("a", "response", "http://x.org/p", 10, 200, {"etag": '"1"'}, b"one"), ("b", "response", "http://y.org/", 10, 200, {"etag": '"1"'}, b"two")]
    rows += [(f"r{i}", "revisit", "http://x.org/p", 20 + i // 2, 304, {"etag": '"1"'}, None) for i in range(10)] + [("r3", "revisit", "http://x.org/p", 21, 304, {"etag": '"1"'}, None)]
    got = warc.resolve(spark.createDataFrame(rows, warc.SCHEMA)).collect()
    assert len(got) == 11 and {(r["refers_to"], bytes(r["body"])) for r in got} == {("a", b"one")} and sum(r["record_id"] == "r3" for r in got) == 2


def test_images_turned_resized_and_cut(spark):
    rng = np.random.default_rng(12)
    pictures = [images.render(rng.normal(size=64).tolist()) for _ in range(10)]
    asked = [(k * 100 + i, images.pgm(change(p))) for k, change in enumerate(images.EDITS.values()) for i, p in enumerate(pictures)]
    indexed, queries = images.points(spark.createDataFrame([(i, images.pgm(p)) for i, p in enumerate(pictures)], "id bigint, image binary")), images.points(spark.createDataFrame(asked, "id bigint, image binary"))
    found = images.copies(queries, indexed).join(images.members(queries).selectExpr("class_key query", "id q"), "query").join(images.members(indexed).selectExpr("class_key match", "id m"), "match")
    met = {(r["q"], r["m"]) for r in found.collect()}
    assert all(q % 100 == m for q, m in met)
    for k in range(len(images.EDITS)):
        assert sum((k * 100 + i, i) in met for i in range(10)) >= 9, k


def test_images_query_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    vector = lambda: rng.normal(size=64).tolist()
    same = vector()
    rows = [(0, vector()), (50, same), (50, same), (51, same), (100, None), (None, vector()), (-50, vector()), *((i, vector()) for i in range(1, 12))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "image", "class_key", "label", "found")})
    got = {r["vec_id"]: r for r in images.search(table).collect()}
    assert set(got) == {0, 50, 100, -50} and got[0]["found"] and got[50]["n_matches"] == 3 and not got[100]["found"] and got[100]["inliers"] == 0 and got[-50]["found"]
    assert images.search(table.where("false")).collect() == []


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    pictures = {i: images.render(rng.normal(size=64).tolist()) for i in range(12)}
    rows = [(i, images.pgm(p)) for i, p in pictures.items()] + [(50, None), (51, b"junk"), (52, images.pgm(np.full((90, 90), 7.0))), (53, images.pgm(pictures[0]))]
    asked = [(100 + i, images.pgm(images.edited(pictures[i]))) for i in range(6)] + [(200, images.pgm(images.render(rng.normal(size=64).tolist())))]
    indexed, queries = images.points(spark.createDataFrame(rows, "id bigint, image binary")), images.points(spark.createDataFrame(asked, "id bigint, image binary"))
    found = images.copies(queries, indexed).join(images.members(queries).selectExpr("class_key query", "id q"), "query").join(images.members(indexed).selectExpr("class_key match", "id m"), "match")
    assert {(r["q"], r["m"]) for r in found.collect()} == {(100 + i, i) for i in range(6)} | {(100, 53)}


def test_image_points_meet_as_by_brute_force():
    rng = np.random.default_rng(5)
    noisy = lambda p: np.clip(p + rng.normal(0, 6, p.shape), 0, 255)
    for change in (noisy, lambda p: images.resized(p, 84, 84), np.rot90, lambda p: noisy(np.rot90(p))):
        pictures = [images.render(rng.normal(size=64).tolist()) for _ in range(6)]
        ours, theirs = ([np.frombuffer(d[3], np.uint64) for p in side for d in images.describe(images.decode(images.pgm(p)))] for side in (pictures, map(change, pictures)))
        want = {(i, j) for i, a in enumerate(theirs) for j, b in enumerate(ours) if np.bitwise_count(a ^ b).sum() <= 15}
        i, j = images.Tables(np.array(ours)).near(np.array(theirs))
        assert len(want) > 50 and len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_image_copies_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pictures = [images.render(rng.normal(size=64).tolist()) for _ in range(10)]
    changes = [lambda p: np.clip(p + rng.normal(0, 8, p.shape), 0, 255), lambda p: images.resized(p, 77, 77)]
    indexed = images.points(spark.createDataFrame([(i, images.pgm(p)) for i, p in enumerate(pictures)], "id bigint, image binary")).persist()
    queries = images.points(spark.createDataFrame([(i, images.pgm(change(p))) for i, (change, p) in enumerate((c, p) for c in changes for p in pictures)], "id bigint, image binary")).persist()
    both = [[(r["class_key"], (r["y"], r["x"], r["scale"]), r["f0"], r["f1"]) for r in images.places(df).collect()] for df in (queries, indexed)]
    pairs = defaultdict(list)
    for q, at, q0, q1 in both[0]:
        for m, own, m0, m1 in both[1]:
            if ((q0 ^ m0) & (2**64 - 1)).bit_count() + ((q1 ^ m1) & (2**64 - 1)).bit_count() <= 15:
                pairs[q, m].append((*at, *own))
    want = {(*k, n) for k, v in pairs.items() if (n := images.agreed(np.array(v))) >= images.CONSENSUS}
    for part in (images.PART, 500):
        monkeypatch.setattr(images, "PART", part)
        rows = images.copies(queries, indexed).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want) >= 10


def test_small_crops_and_halved_copies_of_large_images(spark):
    rng = np.random.default_rng(9)
    large = [90 * images.resized(rng.random((40, 40)), 400, 400) + 120 * images.resized(rng.random((108, 108)), 400, 400) for _ in range(4)]
    halved = lambda p, n: p.reshape(len(p) // n, n, -1, n).mean(axis=(1, 3))
    asked = [(k * 10 + i, images.pgm(change(p))) for i, p in enumerate(large) for k, change in enumerate((lambda p: p[130:220, 200:290], lambda p: halved(p, 2), lambda p: halved(p, 2)[40:160, 60:180], lambda p: halved(p, 4)))]
    indexed, queries = images.points(spark.createDataFrame([(i, images.pgm(p)) for i, p in enumerate(large)], "id bigint, image binary")), images.points(spark.createDataFrame(asked, "id bigint, image binary"))
    found = images.copies(queries, indexed).join(images.members(queries).selectExpr("class_key query", "id q"), "query").join(images.members(indexed).selectExpr("class_key match", "id m"), "match")
    assert {(r["q"], r["m"]) for r in found.collect()} == {(k * 10 + i, i) for k in range(4) for i in range(4)}


def test_whole_splits_no_value():
    rng = np.random.default_rng(8)
    for rows in (1, 3, 20):
        keys = np.sort(rng.integers(0, 12, 60))
        batches = [pa.RecordBatch.from_arrays([pa.array(k)], names=["k"]) for k in np.split(keys, np.sort(rng.integers(0, 60, 6)))]
        got = [t.column(0).to_pylist() for t in images.whole(iter(batches), rows)]
        assert sum(got, []) == keys.tolist() and sum(len(set(g)) for g in got) == len(set(keys.tolist())) and all(got)


def test_points_cost_less_the_more_are_asked_for():
    rng = np.random.default_rng(10)
    prints, asked = (rng.integers(0, 2**63, (n, 2)).astype(np.uint64) for n in (20_000, 400_000))
    asked[::1000] = prints[:400] ^ np.uint64(1 << 20 | 1 << 40)
    tables, took = images.Tables(prints), []
    for n in (4000, 400_000):
        began = time.perf_counter()
        i, j = tables.near(asked[:n])
        took.append(time.perf_counter() - began)
    assert list(i) == list(range(0, 400_000, 1000)) and list(j) == list(range(400))
    assert took[1] < 50 * took[0]  # 100 times where each point is looked up by itself


def test_near_blocks_lose_no_pair():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    for wrong in (15, 16):
        bits = np.zeros((300, 128), np.uint8)
        for row in bits:
            row[rng.choice(128, wrong, replace=False)] = 1
        i, j = images.Tables(prints).near(prints ^ np.packbits(bits, axis=1).view(np.uint64))
        assert list(i) == list(j) == (list(range(300)) if wrong == 15 else [])


def test_png_equals_pgm():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (30).to_bytes(4, "big") + (20).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert np.array_equal(images.decode(png), images.decode(images.pgm(pixels.astype(float))))


def _folder(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    body = "some words of a text that is long enough to have shingles and to be told from others "
    docs = [(1, body * 3, "en", "a", None, "x"), (1, body * 3, "en", "a", None, "x"), (2, body * 3, None, None, 5, None), (3, None, "en", "a", 0, None), (3, None, "en", "a", 0, None), (4, "", None, "b", None, None), (None, "a text without an id, and with some words", "en", "b", 1, None)]
    docs += [(10 + i, f"document number {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "b", 1, None) for i in range(8)]
    folder = _folder(spark, tmp_path, docs, [])
    at = spark.read.parquet(f"{folder}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/out{k}")
        at = spark.read.parquet(f"{folder}/out{k}")
        counts.append(at.count())
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts[0] == len(docs) and counts[1] == counts[2] == 8 + 4  # of three copies one stays, and one of two equal null texts
    assert pipeline.run(spark, folder).count() == counts[4]


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, _folder(spark, tmp_path, [], [])).collect() == []


def test_pipeline_decisions(spark, tmp_path):
    """Each stage against a plain form of its rule, on documents with known copies, passages and insults."""
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    docs, labels = [], []
    for i in range(300):
        insult = " you stupid idiot and pathetic worthless moron " if i % 6 == 0 else " "
        docs.append((i, text(40) + insult + text(30) + (" " + passage if i % 10 == 1 else ""), "en", f"s{i % 3}", 1, None))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "s0", 1, None) for i in (1, 2, 7)] + [(2000 + i, docs[i][1].rsplit(" ", 1)[0], "en", "s1", 1, None) for i in (3, 4)]
    folder = _folder(spark, tmp_path, docs, labels)
    at, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(pipeline.STAGES[:4]):
        stage(spark, at, folder).write.parquet(f"{folder}/out{k}")
        at = spark.read.parquet(f"{folder}/out{k}")
        seen.append([(r["doc_id"], r["text"], r["source"]) for r in at.collect()])
    assert {d for d, _, _ in seen[0]} == {d[0] for d in docs if d[0] % 6 or d[0] >= 1000}
    assert {d for d, _, _ in seen[1]} == {d for d, _, _ in seen[0] if d < 1000}
    kept = {d: t for d, t, _ in seen[2]}
    holders = sorted(d for d in kept if d % 10 == 1)
    assert passage in kept[holders[0]] and all(passage[5:-5] not in kept[d] for d in holders[1:])
    assert all(kept[d] == t for d, t, _ in seen[1] if d % 10 != 1)
    words = defaultdict(int)
    for _, t, s in seen[2]:
        words[s] += len(t.split())
    taken = defaultdict(int)
    for _, t, s in seen[3]:
        taken[s] += len(t.split())
    names = sorted(words)
    for s, target in zip(names, fill([words[s] for s in names], [3, 1, 2], 1.5, 2), strict=True):
        assert abs(taken[s] - target) <= 130


def test_pipeline(spark, small):
    import corpus_pipeline as pipeline

    assert [f for _, f in pipeline.STAGES] == [pipeline.drop_toxic, pipeline.keep_one_of_near_copies, pipeline.cut_repeats, pipeline.mix_sources, pipeline.pack_sequences]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = pipeline.drop_toxic(spark, docs, small).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    one = pipeline.keep_one_of_near_copies(spark, clean, small).cache()
    assert one.count() < clean.count() and one.select("doc_id").distinct().count() == one.count()
    cut = pipeline.cut_repeats(spark, one, small)
    assert cut.count() == one.count() and cut.where("n_chars <> length(text)").count() == 0
    packed = pipeline.run(spark, small)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
