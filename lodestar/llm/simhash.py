"""SimHash fingerprints and the search for those within a Hamming radius, in DataFrame operations only.

A text's terms are its pairs of neighbouring words. Each term's hash votes with
the term's weight on every bit of the fingerprint. The votes of two bits are
summed in the two halves of one long, so 128 bits take 64 sums, which Spark adds
up by document within the task that splits the text.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .common import bucket_edges, bucket_of, enough_buckets

#: Bits of a fingerprint: hashes of 64 bits times HASHES.
HASHES = 2
BITS = 64 * HASHES
LANES = 0x0000000100000001
#: A term weighs as many votes as its words have characters, up to this.
MOST_WEIGHT = 16
SPACE = r"[\x20\x09-\x0D]+"
#: Cells of the filter of fronts that search() broadcasts (some 9 MB, whatever the tables), and 64-bit words in a row of it.
FILTER_BITS, FILTER_WORDS = 1 << 26, 64


def terms(text: Column) -> Column:
    """Array of (h, w): hash and weight of each pair of neighbouring words; the ends of the text count as words."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    weight = lambda a, b: F.least(F.lit(MOST_WEIGHT), F.lit(1) + F.coalesce(F.length(a), F.lit(0)) + F.coalesce(F.length(b), F.lit(0))).cast("bigint")
    return F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), weight(a, b).alias("w")))


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns with f0, f1 (the fingerprint's longs), a row for each distinct key.

    A null text counts as empty. Texts are split once; only 64 sums a text are shuffled.
    """
    voted = texts.select(*key, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("t")).select(*key, F.col("t.h").alias("h0"), F.col("t.w").alias("w"))
    for k in range(1, HASHES):
        voted = voted.withColumn(f"h{k}", F.xxhash64(F.lit(k), "h0"))
    sums = [F.sum(F.shiftrightunsigned(f"h{k}", i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"s{k}_{i}") for k in range(HASHES) for i in range(32)]
    summed = voted.groupBy(*key).agg(F.sum("w").alias("w"), *sums)

    def folded(k: int) -> Column:
        low = [F.when(s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("w"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, s in ((i, F.col(f"s{k}_{i}")) for i in range(32))]
        high = [F.when(F.shiftrightunsigned(s, 32) * 2 > F.col("w"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, s in ((i, F.col(f"s{k}_{i}")) for i in range(32))]
        both = lambda parts: reduce(lambda a, b: a.bitwiseOR(b), parts)
        return F.shiftleft(both(high), 32).bitwiseOR(both(low))

    return summed.select(*key, *(folded(k).alias(f"f{k}") for k in range(HASHES)))


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, HASHES)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def likeness(a: str, b: str) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def as_text(prefix: str) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.col(f"{prefix}{k}")), 16, "0") for k in range(HASHES))))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, is_tail, doc_id, text, next_text): rows in order of doc_id, each with the text after it.

    Ids are cut into buckets of about equal numbers of rows at approximate
    quantiles, whose number follows the rows. One shuffle brings each bucket's texts
    together; the first row of the next bucket (after the last bucket: of the
    first one) comes along as a tail. Null ids come first; rows with one id are
    ordered by their text.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", bucket_of("doc_id", bucket_edges(rows, "doc_id", enough_buckets(rows))))
    # one row a bucket, so at most MOST_BUCKETS
    everything = Window.orderBy("of_bucket")
    firsts = rows.groupBy(F.col("bucket").alias("of_bucket")).agg(F.min("doc_id").alias("first_id"))
    tails = firsts.withColumn("to_bucket", F.coalesce(F.lag("of_bucket").over(everything), F.max("of_bucket").over(Window.partitionBy())))
    tail = rows.join(F.broadcast(tails), (F.col("bucket") == F.col("of_bucket")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("is_tail"))
    copied = F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("is_tail"))
    spread = tail.select("doc_id", "text", F.explode(F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("to")).select("to.bucket", "to.is_tail", "doc_id", "text")
    order_by = Window.partitionBy("bucket").orderBy("is_tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return spread.select("bucket", "is_tail", "doc_id", "text", F.row_number().over(order_by).alias("place"), F.lead("text").over(order_by).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n/2) characters replaced by the first as many of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare(docs: DataFrame, every: int = 50, radius: int = 6, blocks: int = 8) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses (1 - Hamming distance / bits).

    n_within, for the ids that ``every`` divides, is the number of documents
    (itself included) whose fingerprints are within the radius, by search();
    it is null for others, and left out if ``every`` is 0.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text is an
    empty one, whose only term is the pair of its ends, so all empty texts have
    one fingerprint. Of rows with equal ids the next is the one with the next
    text; a single row is its own next. Repeated rows repeat in the result; an
    empty table gives no rows.
    """
    lined = with_next(docs)
    texts = lined.withColumn("edited", F.when(~F.col("is_tail"), edited(F.col("text"), F.col("next_text"))))
    carried = F.struct("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = texts.select(
        "bucket",
        "place",
        "is_tail",
        F.explode(
            F.when(F.col("is_tail"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), F.lit(None).cast("struct<doc_id:bigint,n_chars:bigint,edited_sha256:string>").alias("row")))).otherwise(
                F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body"), carried.alias("row")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body"), F.lit(None).cast("struct<doc_id:bigint,n_chars:bigint,edited_sha256:string>").alias("row")))
            )
        ).alias("x"),
    ).select("bucket", "place", "is_tail", "x.which", "x.body", "x.row.doc_id", "x.row.n_chars", "x.row.edited_sha256")
    marked = fingerprints(both, ["bucket", "place", "is_tail", "which", "doc_id", "n_chars", "edited_sha256"], "body")
    pick = lambda which, name: F.max(F.when(F.col("which") == which, F.col(name)))
    rows = marked.groupBy("bucket", "place", "is_tail").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_chars", "edited_sha256")), *(pick(0, f"f{k}").alias(f"f{k}") for k in range(HASHES)), *(pick(1, f"f{k}").alias(f"g{k}") for k in range(HASHES))
    )
    after = Window.partitionBy("bucket").orderBy("is_tail", "place")
    rows = rows.withColumns({f"n{k}": F.lead(f"f{k}").over(after) for k in range(HASHES)}).where(~F.col("is_tail"))
    out = ["doc_id", "n_chars", "edited_sha256", as_text("f").alias("fingerprint"), as_text("g").alias("edited_fingerprint"), likeness("f", "g").alias("near_edited"), likeness("f", "n").alias("near_next")]
    if not every:
        return rows.select(*out)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # some numbers and two hashes a document
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    prints = [f"f{k}" for k in range(HASHES)]
    asked = rows.where(is_query).groupBy(*prints).agg(F.min("doc_id").alias("doc_id"))
    counts = search(asked, rows, "doc_id", radius, blocks).groupBy(F.col("query").alias("doc_id")).agg(F.sum("members").alias("n_within"))
    known = asked.join(counts, "doc_id").select(*prints, "n_within")
    queries = rows.where(is_query).join(known, prints, "left")
    return queries.select(*out, "n_within").union(rows.where(~is_query).select(*out, F.lit(None).cast("bigint").alias("n_within")))


def search(queries: DataFrame, marked: DataFrame, key: str, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(query, class_id, members, bits): for each query all distinct fingerprints at most ``radius`` bits away.

    Both tables have ``key``, f0 and f1. The fingerprint is cut into ``blocks``
    equal blocks. Two within the radius agree in blocks - radius of them at
    least, so there is a table for each choice of that many blocks, in which the
    fingerprint is permuted to have these blocks in front, and rows that agree
    there meet. A pair is reported by the first table that it meets in. Equal
    fingerprints are one entry, named by the smallest key, with the number of
    its members: copies never give pairs. Null keys are never the name of a
    class that has others.

    Of the entries' rows (one a table) only those whose front hashes into a cell
    of some query's go to the join; where queries fill the filter, all do. The
    join is one of sorted rows: Spark guesses the queries' size before they are
    multiplied by the tables, and would broadcast too many of them.
    """
    width = BITS // blocks
    if not 0 <= radius < blocks or BITS % blocks or 64 % width:
        raise ValueError("blocks must be more than the radius and cut each long evenly")
    choices = [*combinations(range(blocks), blocks - radius)]
    block = lambda p, i: F.shiftrightunsigned(F.col(f"{p}{i * width // 64}"), i * width % 64).bitwiseAND(F.lit((1 << width) - 1))

    def tables(df: DataFrame, name: str, p: str, more: list[str]) -> DataFrame:
        fronts = F.array(*(F.xxhash64(F.lit(t), *(block("f", i) for i in choice)) for t, choice in enumerate(choices)))
        return df.select(F.col(name), *more, *(F.col(f"f{k}").alias(f"{p}{k}") for k in range(HASHES)), F.posexplode(fronts).alias("t", "front"))

    left = tables(queries.select(F.col(key).alias("query"), *(f"f{k}" for k in range(HASHES))), "query", "a", [])
    right = in_filter(tables(classes(marked, key), "class_id", "b", ["members"]), front_filter(left))
    met = left.hint("merge").join(right, ["t", "front"]).where(distance("a", "b") <= radius)
    agree = lambda choice: reduce(lambda x, y: x & y, [block("a", i) == block("b", i) for i in choice])
    first = F.coalesce(*(F.when(agree(choice), F.lit(t)) for t, choice in enumerate(choices)))
    return met.where(F.col("t") == first).select("query", "class_id", "members", distance("a", "b").alias("bits"))


def _cell() -> tuple[Column, Column, Column]:
    """A front's place in the filter: row, word in the row, bit in the word."""
    cell = F.pmod("front", F.lit(FILTER_BITS))
    word = F.floor(cell / 64)
    return F.floor(word / FILTER_WORDS), (word % FILTER_WORDS).cast("int"), (cell % 64).cast("int")


def front_filter(asked: DataFrame) -> DataFrame:
    """(part, words): bitmaps of the cells that the fronts of ``asked`` hash into."""
    part, word, bit = _cell()
    cells = asked.select(part.alias("part"), word.alias("word"), bit.alias("bit")).repartition("part")
    one = F.expr("shiftleft(1L, bit)")
    return cells.groupBy("part").agg(F.array(*(F.bit_or(F.when(F.col("word") == i, one).otherwise(F.lit(0).cast("bigint"))) for i in range(FILTER_WORDS))).alias("words"))


def in_filter(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows whose front hashes into a cell of the filter."""
    part, word, bit = _cell()
    return rows.join(F.broadcast(cells), part == F.col("part")).where(F.getbit(F.get("words", word), bit) == 1).select(*rows.columns)


def classes(marked: DataFrame, key: str) -> DataFrame:
    """One row (class_id, members, f0, f1) for each distinct fingerprint."""
    return marked.groupBy(*(f"f{k}" for k in range(HASHES))).agg(F.min(key).alias("class_id"), F.count("*").alias("members"))
