"""Spelling variants by symmetric deletes.

Every word of the vocabulary emits itself and its distinct single deletions
under a hash of each. Words that share a key meet in an equi-join, and those
that really are one edit apart are near. A word's form is its commonest near
word, if that is far commoner; forms are followed to the last one by joins.

The corpus is gone through once, for counts of words; everything behind that
grows with the vocabulary. How many words can share a key is bounded by the
alphabet and the word's length, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, store

#: What a run of letters is, and how often one of its letters is lost.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSSES = 199
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
ROUNDS = 64


def _without(word: Column, at: Column) -> Column:
    """``word`` without its character ``at``, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def with_losses(docs: DataFrame, letters: str = LETTERS, losses: int = LOSSES) -> DataFrame:
    """(word): every run of letters in lower case; a checksum of document and run decides which of them lose a letter, and which."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(letters), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")))
    lost = F.col("doc_id").isNotNull() & (F.col("h") % losses == 0)
    return hashed.select(F.when(lost, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; tasks count before the shuffle."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def emitted(words: DataFrame) -> DataFrame:
    """(key, word, n): a word under the hash of itself and of each of its distinct single deletions."""
    places = F.sequence(F.lit(0), F.length("word") - 1)
    keys = F.array_distinct(F.concat(F.array(F.xxhash64("word")), F.transform(places, lambda i: F.xxhash64(_without(F.col("word"), i)))))
    return words.select(F.explode(keys).alias("key"), "word", "n")


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all pairs, both ways, that are exactly one inserted, deleted or replaced character apart."""
    keyed = emitted(words)
    pairs = keyed.hint("merge").join(keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "key").where("word < other")
    found = pairs.where(F.levenshtein("word", "other", 1) == 1).groupBy("word", "other").agg(F.first("n").alias("n"), F.first("other_n").alias("other_n"))  # some share two keys
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return found.select(F.explode(both).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the last one that forms lead to.

    A form is commoner than its word, so there are no circles. Every round goes twice as far.
    """
    at, at_in = store(forms.select("word", F.col("form").alias("root")))
    for _ in range(ROUNDS):
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new, new_in = store(at.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        remove(forms.sparkSession, at_in)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at, at_in = new.select("word", "root"), new_in
    raise RuntimeError(f"roots still change after {ROUNDS} rounds")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of ``words`` (word, n), which are distinct.

    The form is the near word of the largest n, of equal ones the first by code point, if it has ``times`` the word's n;
    the root is where forms lead, the word itself if it has none. An empty table gives no rows.
    """
    words = cut(words.select("word", "n"))
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own_n"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best"))
    enough = -F.col("best.m") >= F.col("own_n") * times
    chosen = cut(best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")))
    found = chosen.join(roots(chosen.where("form is not null")), "word", "left")
    return words.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("bigint").alias("n"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("form_n").cast("bigint").alias("form_n"))


def group(docs: DataFrame) -> DataFrame:
    """variants() of the words of all whole texts.

    Takes ``doc_id`` and ``text``; other columns are not read. A null text has no words; the runs of a row without an id
    lose no letter. Repeated rows count each time. An empty table, or one without frequent words, gives no rows.
    """
    return variants(vocabulary(with_losses(docs)))


_CRC = "xor(list_reduce(flatten(list_transform({0}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0])), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)), 4294967295), 4294967295)"
_BYTES = "flatten(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN unicode(substr({0}, i, 1)) < 128 THEN [unicode(substr({0}, i, 1))::BIGINT] ELSE [192 + unicode(substr({0}, i, 1)) // 64, 128 + unicode(substr({0}, i, 1)) % 64]::BIGINT[] END))"

GROUP_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents) WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL
), hashed AS (
  SELECT *, {_CRC.format(_BYTES.format("(doc_id || ':' || run)"))} AS h FROM runs
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {LOSSES} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), deletions AS MATERIALIZED (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS key, i FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM deletions a JOIN deletions b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN deletions b ON a.word = b.key
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN deletions b ON a.word = b.key
), best AS MATERIALIZED (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other COLLATE "C") AS form, max(other_n) AS form_n FROM near GROUP BY word, n
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT p.word, p.root FROM path p JOIN formed e ON e.word = p.root WHERE e.form IS NULL) p ON p.word = f.word
"""
