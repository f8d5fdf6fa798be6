"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm import language, minhash, mixing, packing, quality, repeats, simhash, toxicity

LONG = "a rather long text about nothing in particular " * 4000
ROWS = [
    (1, "One two three four five six seven.", "en", "s1"),
    (1, "One two three four five six seven.", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, None),
    (4, " \n\t ", "fr", "s2"),
    (5, LONG, "en", "s2"),
    (None, "Null id here, some words and more words.", "fr", "s1"),
    (6, "x", "fr", None),
    (7, "emoji \U0001f600 and \x00 zero bytes " + "z" * 300, "en", "s3"),
    (8, "One two three four five six seven.", None, "s3"),
]
CLASHING = ("score", "kept", "spans", "row", "copies", "taken", "component_id", "text_key", "hash", "size", "held_out", "predicted", "root", "bucket", "version", "n_bytes", "class_key", "id", "k0", "copy")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (6, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, x: toxicity.classify(d, x),
    "mixing": lambda d, x: mixing.mix(d),
    "language": lambda d, x: language.identify(d),
    "minhash": lambda d, x: minhash.group(d),
    "quality": lambda d, x: quality.classify(d, x),
    "simhash": lambda d, x: simhash.compare(d),
    "repeats": lambda d, x: repeats.digest(d),
    "kept_repeats": lambda d, x: repeats.remove(d, as_text=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_result(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", [*OPERATORS, "packing", "keep_one"])
def test_empty_table(name, docs, labels):
    none = docs.where("false")
    run = OPERATORS.get(name) or {"packing": lambda d, x: packing.pack(d), "keep_one": lambda d, x: minhash.keep_one(d)}[name]
    assert run(none, labels).collect() == []
    assert run(none, labels.where("false")).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_no_labels(name, docs, labels):
    scores = {r["score"] for r in OPERATORS[name](docs, labels.where("false")).collect()}
    assert len(scores) == 1


def test_repeated_rows_agree(docs, labels):
    for name in ("toxicity", "language", "minhash", "quality", "repeats"):
        twins = [tuple(r) for r in OPERATORS[name](docs, labels).where("doc_id = 1").collect()]
        assert len(twins) == 2 and twins[0] == twins[1], name


def test_defined_results(docs, labels):
    tongue = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert tongue[2] == tongue[3] == tongue[4] == "und"
    group = {r["doc_id"]: r for r in minhash.group(docs).collect()}
    assert group[2]["n_shingles"] == 0 and group[2]["component_id"] == 2 and group[2]["kept"]
    assert group[8]["component_id"] == 1 and not group[8]["kept"] and group[1]["kept"]
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert mixed[2]["size"] == 0 and mixed[2]["taken"] == 0
    prints = {r["doc_id"]: r for r in simhash.compare(docs).collect()}
    assert prints[2]["fingerprint"] == prints[3]["fingerprint"] == prints[4]["fingerprint"]
    assert prints[1]["fingerprint"] == prints[8]["fingerprint"]


def test_keep_one_keeps_columns_and_one_row(docs):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 8 not in ids and {2, 3, 4, 5, 7} <= set(ids) and None in ids
