"""Three-way merge of two branches of a table of documents by sparse edit logs.

A branch is not a copy of the table but a log: one row for each unit (the row,
a column, a line, the gap behind a line) that it changes, and none for those
that it leaves. The two logs meet in a full outer join by document and unit,
each pair is classified, and what is resolved is applied to the base as a patch.
So only changes are joined; texts are shuffled once, beside their own patches.

A log has (doc_id, version, part, at, value). ``part`` is one of ROW, LANG,
SOURCE, LINE and GAP, ``at`` the line's number (0 for the others), and
``value`` what the unit becomes; null drops a row or a line. ``version`` is a
hash of the base row, so that rows that share an id are merged apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW, LANG, SOURCE, LINE, GAP = range(5)
KEY = ("doc_id", "version")
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
#: The modulus of a unit's code, what codes 1 and 2 append and 3 and 4 insert, and from what an added row's id is counted down.
MODULUS = 17
APPENDED = {1: "!", 2: "?"}
INSERTED = {3: "!", 4: "?"}
ADDED_FROM = {"L": -1, "R": -5}


def base_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, version) of every row, nulls as empty strings; other columns are not read."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return own.withColumn("version", F.xxhash64("text", "lang", "source"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _code(branch: str, name: Column) -> Column:
    """What the branch does to a unit: a number under MODULUS, null where the document has no id."""
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.col("doc_id").cast("string"), F.lit(":"), name).cast("binary")) % MODULUS


def _chosen(code: Column, values: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def drawn_log(base: DataFrame, branch: str) -> DataFrame:
    """The log of a branch whose changes are drawn by the checksum of branch, id and unit: some five of seventeen units."""
    unit = lambda part, at, value: F.struct(F.lit(part).alias("part"), F.lit(at).cast("int").alias("at"), value.cast("string").alias("value"))
    column = lambda part, name: F.when((_code(branch, F.lit(name)) == 0) & (F.col(name) != ""), unit(part, 0, F.lit(""))).when(_code(branch, F.lit(name)).isin(*APPENDED), unit(part, 0, F.concat(F.col(name), _chosen(_code(branch, F.lit(name)), APPENDED))))
    whole = F.array(F.when(_code(branch, F.lit("row")) == 0, unit(ROW, 0, F.lit(None))), column(LANG, "lang"), column(SOURCE, "source"))
    coded = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.cast("int").alias("i"), line.alias("line"), _code(branch, i.cast("string")).alias("code")))
    changed = F.transform(
        F.filter(coded, lambda x: x["code"] <= max(INSERTED)),
        lambda x: F.struct(F.when(x["code"].isin(*INSERTED), GAP).otherwise(LINE).alias("part"), x["i"].alias("at"), F.when(x["code"].isin(*INSERTED), _chosen(x["code"], INSERTED)).when(x["code"] > 0, F.concat(x["line"], _chosen(x["code"], APPENDED))).alias("value")),
    )
    return base.select(*KEY, F.explode(F.concat(F.filter(whole, lambda x: x.isNotNull()), changed)).alias("x")).select(*KEY, "x.*")


def drawn_rows(base: DataFrame, branch: str) -> DataFrame:
    """(doc_id, text, lang, source): the rows that such a branch adds."""
    code = _code(branch, F.lit("row"))
    return base.where(code.isin(*INSERTED)).select((F.lit(ADDED_FROM[branch]) - F.col("doc_id")).alias("doc_id"), _chosen(code, INSERTED).alias("text"), "lang", "source")


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """The full outer join of two logs: (key, part, at, l, r), each a struct of the value that a branch gives, null where it changes nothing."""
    unit = [*KEY, "part", "at"]
    one = lambda log, name: log.groupBy(*unit).agg(F.first(F.struct("value")).alias(name)).hint("merge")  # noqa: E731  a repeated row's log is the same
    return one(left, "l").join(one(right, "r"), unit, "full")


def patches(pairs: DataFrame) -> DataFrame:
    """(key, drop_l, drop_r, change_l, change_r, counts, changes) a document: how its pairs were classified, and what each branch says of its units, in order.

    One-sided and equal changes are clean. Of others, an edited line that the other branch drops is an edit-delete
    conflict, two insertions into a gap an insert-insert one, the rest edit-edit ones. A document has as many changes as units.
    """
    inside, both = F.col("part") != ROW, F.col("l").isNotNull() & F.col("r").isNotNull()
    differ = both & ~F.col("l.value").eqNullSafe(F.col("r.value"))
    deleted = (F.col("part") == LINE) & (F.col("l.value").isNull() | F.col("r.value").isNull())
    has = lambda side, where: F.coalesce(F.bool_or(where & F.col(side).isNotNull()), F.lit(False))
    return pairs.groupBy(*KEY).agg(
        has("l", ~inside).alias("drop_l"), has("r", ~inside).alias("drop_r"), has("l", inside).alias("change_l"), has("r", inside).alias("change_r"), F.count_if(inside & ~differ).alias("n_clean"),
        F.count_if(inside & differ & ~deleted & (F.col("part") != GAP)).alias("n_edit_edit"), F.count_if(inside & differ & deleted).alias("n_edit_delete"), F.count_if(inside & differ & (F.col("part") == GAP)).alias("n_insert_insert"),
        F.array_sort(F.collect_list(F.when(inside, F.struct("part", "at", "l", "r")))).alias("changes"),
    )


def _dense(changes: Column, part: int, n: Column) -> Column:
    """The resolved changes of one part as an array with a place for each of ``n`` lines, null where nothing changes."""
    own = F.filter(changes, lambda x: x["part"] == part)
    before = F.concat(F.array(F.lit(-1)), F.transform(own, lambda x: x["at"]))
    nothing = F.lit(None).cast("struct<value: string>")
    placed = F.zip_with(own, before, lambda x, b: F.when(x.isNotNull(), F.concat(F.array_repeat(nothing, x["at"] - b - 1), F.array(x["to"]))).otherwise(F.array().cast("array<struct<value: string>>")))
    filled = F.flatten(placed)
    return F.concat(filled, F.array_repeat(nothing, n - F.size(filled)))


def applied(base: DataFrame, patched: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text, counts): base rows after the merge; all three are null where the row is dropped.

    A conflict takes what the left branch has. A row that both drop, or that one drops while the other leaves it as it is, is
    gone and counts one clean change; one that the other changes counts one edit-delete conflict, whatever its units do.
    """
    rows = base.join(patched.hint("merge"), [*KEY], "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    one_drops = no("drop_l") | no("drop_r")
    torn = (no("drop_l") & ~no("drop_r") & no("change_r")) | (no("drop_r") & ~no("drop_l") & no("change_l"))
    gone = no("drop_l") | (no("drop_r") & ~no("change_l"))
    only_left = no("drop_r") & ~no("drop_l")
    to = lambda x: F.when(x["l"].isNotNull() | only_left, x["l"]).otherwise(x["r"])
    resolved = F.filter(F.transform(F.coalesce("changes", F.array().cast(patched.schema["changes"].dataType)), lambda x: F.struct(x["part"].alias("part"), x["at"].alias("at"), to(x).alias("to"))), lambda x: x["to"].isNotNull())
    rows = rows.select("doc_id", "text", "lang", "source", gone.alias("gone"), one_drops.alias("one_drops"), torn.alias("torn"), *COUNTS, resolved.alias("resolved"))
    column = lambda part, name: F.coalesce(F.get(F.filter("resolved", lambda x: x["part"] == part), F.lit(0))["to"]["value"], F.col(name))
    of_line = F.zip_with(_lines(F.col("text")), _dense(F.col("resolved"), LINE, F.size(_lines(F.col("text")))), lambda line, to: F.when(to.isNull(), F.array(line)).when(to["value"].isNull(), F.array().cast("array<string>")).otherwise(F.array(to["value"])))
    behind = _dense(F.col("resolved"), GAP, F.size(_lines(F.col("text"))))
    merged = F.array_join(F.flatten(F.zip_with(of_line, behind, lambda lines, to: F.when(to.isNull(), lines).otherwise(F.concat(lines, F.array(to["value"]))))), "\n")
    still = lambda c: F.when(~F.col("gone"), c)
    inner = lambda c: F.when(F.col("one_drops"), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    counts = [
        F.when(F.col("one_drops"), (~F.col("torn")).cast("bigint")).otherwise(inner("n_clean")).alias("n_clean"), inner("n_edit_edit").alias("n_edit_edit"),
        F.when(F.col("one_drops"), F.col("torn").cast("bigint")).otherwise(inner("n_edit_delete")).alias("n_edit_delete"), inner("n_insert_insert").alias("n_insert_insert"),
    ]
    changed = F.when(F.size("resolved") == 0, F.col("text")).otherwise(merged)
    return rows.select("doc_id", still(column(LANG, "lang")).alias("lang"), still(column(SOURCE, "source")).alias("source"), still(changed).alias("text"), *counts)


def added(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text, counts): rows that the branches add; different ones of one id are one conflict and take the left branch's."""
    one = lambda rows, name: rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias(name)).hint("merge")
    both = one(left, "l").join(one(right, "r"), "doc_id", "full").withColumn("to", F.coalesce("l", "r"))
    differ = F.coalesce(F.col("l") != F.col("r"), F.lit(False))
    return both.select("doc_id", "to.lang", "to.source", "to.text", (~differ).cast("bigint").alias("n_clean"), F.lit(0).cast("bigint").alias("n_edit_edit"), F.lit(0).cast("bigint").alias("n_edit_delete"), differ.cast("bigint").alias("n_insert_insert"))


def merge(base: DataFrame, logs: tuple[DataFrame, DataFrame], rows: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc_id, lang, source, text, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) of every id that ever was.

    ``base`` as base_of() gives it, the left and right branch's ``logs``, and the ``rows`` that each adds. Rows that share an
    id are merged each by itself; of rows of one id that one branch adds the least counts. A row without an id has no
    changes. An added row whose id the base has already is a row of its own. An empty base with no added rows gives none.
    """
    return applied(base, patches(paired(*logs))).unionByName(added(*rows))


def drawn(docs: DataFrame) -> DataFrame:
    """merge() of the two branches L and R whose changes checksums draw."""
    base = base_of(docs)
    return merge(base, (drawn_log(base, "L"), drawn_log(base, "R")), (drawn_rows(base, "L"), drawn_rows(base, "R")))


def digest(docs: DataFrame) -> DataFrame:
    """drawn() with the hash of the text in its place; a null text, lang or source is an empty one before any change."""
    return drawn(docs).select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)


#: The checksum of an ASCII string, a bit at a time.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)), 4294967295), 4294967295)"
_CODE = "(" + _CRC.format("('{0}:' || doc_id || ':' || name)") + " % 17)"
_APPEND = "CASE {0} WHEN 0 THEN {2} WHEN 1 THEN {1} || '!' WHEN 2 THEN {1} || '?' ELSE {1} END"
_INSERT = "CASE {0} WHEN 3 THEN '!' WHEN 4 THEN '?' END"

DIGEST_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), named AS (
  SELECT doc_id, unnest(['row', 'lang', 'source']) AS name, NULL AS line, -1 AS i FROM base
  UNION ALL SELECT doc_id, i::VARCHAR, line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM base)
), coded AS (
  SELECT *, {_CODE.format("L")} AS l, {_CODE.format("R")} AS r FROM named
), lined AS (
  SELECT doc_id, i, l, r, l <= 2 AS lc, r <= 2 AS rc, l IN (3, 4) AS lg, r IN (3, 4) AS rg,
         {_APPEND.format("l", "line", "NULL")} AS lv, {_APPEND.format("r", "line", "NULL")} AS rv, {_INSERT.format("l")} AS li, {_INSERT.format("r")} AS ri
  FROM coded WHERE i >= 0
), lines AS (
  SELECT doc_id, bool_or(l <= 4) AS any_l, bool_or(r <= 4) AS any_r,
         count(*) FILTER ((lc OR rc) AND NOT (lc AND rc AND l <> r)) + count(*) FILTER ((lg OR rg) AND NOT (lg AND rg AND l <> r)) AS clean,
         count(*) FILTER (lc AND rc AND l <> r AND l > 0 AND r > 0) AS ee, count(*) FILTER (lc AND rc AND l <> r AND (l = 0 OR r = 0)) AS ed, count(*) FILTER (lg AND rg AND l <> r) AS ii,
         string_agg(CASE WHEN own IS NULL THEN gap WHEN gap IS NULL THEN own ELSE own || chr(10) || gap END, chr(10) ORDER BY i) AS both_text,
         string_agg(CASE WHEN lv IS NULL THEN li WHEN li IS NULL THEN lv ELSE lv || chr(10) || li END, chr(10) ORDER BY i) AS left_text
  FROM (SELECT *, CASE WHEN lc THEN lv ELSE rv END AS own, CASE WHEN lg THEN li ELSE ri END AS gap FROM lined) GROUP BY doc_id
), codes AS (
  SELECT doc_id, max(l) FILTER (name = 'row') AS row_l, max(r) FILTER (name = 'row') AS row_r, max(l) FILTER (name = 'lang') AS lang_l, max(r) FILTER (name = 'lang') AS lang_r,
         max(l) FILTER (name = 'source') AS source_l, max(r) FILTER (name = 'source') AS source_r FROM coded WHERE i < 0 GROUP BY doc_id
), valued AS (
  SELECT *, {_APPEND.format("lang_l", "lang", "''")} AS ll, {_APPEND.format("lang_r", "lang", "''")} AS lr, {_APPEND.format("source_l", "source", "''")} AS sl, {_APPEND.format("source_r", "source", "''")} AS sr
  FROM base JOIN codes USING (doc_id) JOIN lines USING (doc_id)
), judged AS (
  SELECT *, row_l = 0 AS dl, row_r = 0 AS dr, any_l OR ll <> lang OR sl <> source AS cl, any_r OR lr <> lang OR sr <> source AS cr,
         (ll <> lang OR lr <> lang)::INT AS lang_c, (ll <> lang AND lr <> lang AND ll <> lr)::INT AS lang_x, (sl <> source OR sr <> source)::INT AS source_c, (sl <> source AND sr <> source AND sl <> sr)::INT AS source_x
  FROM valued
), done AS (
  SELECT *, dl OR (dr AND NOT cl) AS gone, (dl AND NOT dr AND cr) OR (dr AND NOT dl AND cl) AS torn FROM judged
), rows_added AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source, coalesce(a.t, b.t) AS t, coalesce(a.t <> b.t OR a.lang <> b.lang OR a.source <> b.source, false) AS x
  FROM (SELECT -1 - doc_id AS doc_id, {_INSERT.format("row_l")} AS t, lang, source FROM valued WHERE row_l IN (3, 4)) a
  FULL JOIN (SELECT -5 - doc_id AS doc_id, {_INSERT.format("row_r")} AS t, lang, source FROM valued WHERE row_r IN (3, 4)) b ON a.doc_id = b.doc_id
)
SELECT doc_id, CASE WHEN gone THEN NULL WHEN dr OR ll <> lang THEN ll ELSE lr END AS lang, CASE WHEN gone THEN NULL WHEN dr OR sl <> source THEN sl ELSE sr END AS source,
       CASE WHEN NOT gone THEN sha256(coalesce(CASE WHEN dr THEN left_text ELSE both_text END, '')) END AS text_sha256,
       (CASE WHEN dl OR dr THEN (NOT torn)::INT ELSE clean + lang_c - lang_x + source_c - source_x END)::BIGINT AS n_clean, (CASE WHEN dl OR dr THEN 0 ELSE ee + lang_x + source_x END)::BIGINT AS n_edit_edit,
       (CASE WHEN dl OR dr THEN torn::INT ELSE ed END)::BIGINT AS n_edit_delete, (CASE WHEN dl OR dr THEN 0 ELSE ii END)::BIGINT AS n_insert_insert
FROM done
UNION ALL SELECT doc_id, lang, source, sha256(t), (NOT x)::BIGINT, 0, 0, x::BIGINT FROM rows_added
"""
