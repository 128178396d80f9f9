import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.lexicon import UKRAINIAN
from corpuskit.operators import weak
from corpuskit.plans import fixtures as fx
from corpuskit.schema import LABELS


def brute(value, label):
    value = value.lower()
    mine = [(k, v) for name, k, v in UKRAINIAN if name == label]
    return int(any(v in value if k == "word" else bool(re.search(v, value)) for k, v in mine))


SENTENCES = [
    "Я тебе вб'ю, якщо ти ще раз так скажеш.",
    "Добрий день, друзі!",
    "Ти придурок",
    "Здохни, дурень, сука",
    "Перевбити рашист",
    "",
]


def test_builtin_lexicon_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, comment string")
    for row in weak.weak_label(df).collect():
        value = SENTENCES[row["id"]]
        for label in weak.RULED_LABELS:
            assert row[label] == brute(value, label), (value, label)
        severe = row["obscene"] and (row["threat"] or row["insult"] or row["identity_hate"])
        assert row["severe_toxic"] == int(bool(severe))
        assert row["toxic"] == int(any(row[c] for c in LABELS[1:]))


def test_builtin_lexicon_equals_brute_force_on_cyrillic_documents(spark, small):
    rows = fx.cyrillic(spark, small)
    texts = {r["id"]: r["comment"] for r in rows.collect()}
    for row in weak.weak_label(rows).collect():
        for label in weak.RULED_LABELS:
            assert row[label] == brute(texts[row["id"]], label)


def test_lexicon_table_escaping_and_bad_kind(spark):
    table = spark.createDataFrame([("insult", "word", "a.b"), ("insult", "word", "c+"), ("threat", "pattern", "x|y")],
                                  "label string, kind string, value string")
    df = spark.createDataFrame([(1, "a.b"), (2, "axb"), (3, "C+"), (4, "y")], "id int, comment string")
    got = {r["id"]: (r["insult"], r["threat"]) for r in weak.weak_label(df, table).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (0, 1)}
    with pytest.raises(ValueError):
        weak.lexicon_rows([("insult", "stem", "x")])


def test_regexes_run_in_one_projection(spark):
    df = spark.createDataFrame([(1, "x")], "id int, comment string")
    plan = weak.weak_label(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") == len(weak.RULED_LABELS)
    assert F is not None


def test_back_references_keep_their_own_groups(spark):
    df = spark.createDataFrame([("xx yy",), ("q",), ("xy",), ("ab ab",)], "t string")
    hits = df.select(weak.contains_vocab(F.col("t"), ["zz"], ["(q)", r"(.)\1", r"(?<p>ab) \k<p>"])).collect()
    assert [r[0] for r in hits] == [1, 1, 0, 1]
