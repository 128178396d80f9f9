"""Views over the given tables that have the shapes of the operators' inputs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.text import word_count
from corpuskit.operators.project import row_count
from corpuskit.schema import IDENTITIES, LABELS

# --- Fixed values: a label column is set where the id is a multiple of this ---
MULTIPLES = {
    "severe_toxic": 29,
    "obscene": 5,
    "threat": 17,
    "insult": 3,
    "identity_hate": 11,
    "male": 7,
    "female": 13,
    "homosexual_gay_or_lesbian": 19,
    "christian": 23,
    "jewish": 31,
    "muslim": 37,
    "black": 41,
    "white": 43,
    "psychiatric_or_mental_illness": 47,
}
LEXICON = [
    ("obscene", "pattern", "(the.?n|qu.?e)"),
    ("insult", "pattern", "(tion|ndre)"),
    ("threat", "pattern", "(with.by|der.die)"),
    ("identity_hate", "pattern", "(eau|ent.i)"),
]
PROMPT = "Translate each line. Answer with a JSON list of objects that have an id and a translated text.\n"
LATIN = "abcdefghijklmnoprstuvxyzéèêçäöüß"
CYRILLIC = "абсдефгхіжклмнопрстувяйзєїьщиюшц"
WIKI_PREFIX = "::{{tpl|x}} [[File:a b]] 12:30, May 5, 2008 (UTC) 10.0.0.1 "
# ------------------------------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder) -> DataFrame:
    """The documents; ``corpuskit.documents.partitions`` deals a single small file out to that many tasks."""
    rows = table(spark, folder, "documents")
    partitions = spark.conf.get("corpuskit.documents.partitions", None)
    return rows.repartition(int(partitions), "doc_id") if partitions else rows


def comments(spark, folder, text: bool = True) -> DataFrame:
    """Labelled corpus with fractional target; one label source is a real table."""
    docs = documents(spark, folder)
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("given"))
    rows = docs.join(labels, "doc_id", "left")
    fallback = F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    target = F.when(F.col("doc_id") % 13 != 0, ((F.col("doc_id") * 37) % 101).cast("double") / 100)
    rows = rows.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("comment_text"),
        word_count(F.col("text")).alias("comment_length"),
        F.coalesce("given", fallback).alias("toxic"),
        *[F.when(F.col("doc_id") % m == 0, 1).otherwise(0).alias(c) for c, m in MULTIPLES.items()],
        target.alias("target"),
    )
    return row_count(row_count(rows, LABELS, "label_count"), IDENTITIES, "category_count")


def scores(spark, folder) -> DataFrame:
    """Logits, truth and six-digit probabilities for six labels."""
    rows = table(spark, folder, "embeddings")
    columns = [F.col("vec_id").alias("id")]
    for i, c in enumerate(LABELS):
        z = F.col("embedding")[i].cast("double") * 10
        y = F.when((F.col("label") % 6 == i) | (F.col("vec_id") % (i + 5) == 0), 1).otherwise(0)
        p = F.round(1 / (1 + F.exp(-z)), 6)
        columns += [z.alias(f"z_{c}"), y.alias(f"y_{c}"), p.alias(f"p_{c}")]
    return rows.select(*columns)


def decoration(text) -> Column:
    """A handle, a link and a tag in front of a text."""
    i = F.col("doc_id").cast("string")
    tag = (F.col("doc_id") % 7).cast("string")
    return F.concat(F.lit("@user"), i, F.lit(" https://ex.org/"), i, F.lit(" #tag"), tag, F.lit(" "), text)


def decorated(spark, folder) -> DataFrame:
    return documents(spark, folder).select("doc_id", decoration(F.col("text")).alias("t"))


def translations(spark, folder) -> DataFrame:
    """Stored translations: the documents of the labels table, in lower case."""
    done = table(spark, folder, "labels").select("doc_id").distinct()
    rows = documents(spark, folder).join(done, "doc_id", "left_semi")
    return rows.select(F.col("doc_id").alias("id"), F.lower("text").alias("translated"))


def cyrillic(spark, folder) -> DataFrame:
    """Documents in Cyrillic letters, for the built-in lexicon."""
    text = F.translate(F.lower("text"), LATIN, CYRILLIC)
    return documents(spark, folder).select(F.col("doc_id").alias("id"), text.alias("comment"))


# --- the same views as SQL for the comparison engine --------------------------
def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_COMMENTS = f"""
comments AS (
  SELECT *,
         {' + '.join(LABELS)} AS label_count,
         {' + '.join(IDENTITIES)} AS category_count
  FROM (
    SELECT d.doc_id AS id, d.text AS comment_text,
           CAST(len(regexp_extract_all(d.text, '\\S+')) AS INT) AS comment_length,
           CAST(coalesce(l.toxic, CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END) AS INT) AS toxic,
           {', '.join(f'CASE WHEN d.doc_id % {m} = 0 THEN 1 ELSE 0 END AS {c}' for c, m in MULTIPLES.items())},
           CASE WHEN d.doc_id % 13 <> 0 THEN CAST((d.doc_id * 37) % 101 AS DOUBLE) / 100 END AS target
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))
"""

SQL_SCORES = (
    "scores AS (SELECT *, "
    + ", ".join(f"round(1 / (1 + exp(-z_{c})), 6) AS p_{c}" for c in LABELS)
    + " FROM (SELECT vec_id AS id, "
    + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) * 10 AS z_{c}, "
        f"CASE WHEN label % 6 = {i} OR vec_id % {i + 5} = 0 THEN 1 ELSE 0 END AS y_{c}"
        for i, c in enumerate(LABELS)
    )
    + " FROM embeddings))"
)

SQL_LONG = (
    "long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS label, z_{c} AS z, p_{c} AS p, y_{c} AS y FROM scores" for c in LABELS)
    + ")"
)

SQL_DECORATED = (
    "decorated AS (SELECT doc_id, concat('@user', doc_id, ' https://ex.org/', doc_id, ' #tag', doc_id % 7, "
    "' ', text) AS t FROM documents)"
)

SQL_TRANSLATIONS = (
    "translations AS (SELECT doc_id AS id, lower(text) AS translated FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels))"
)

SQL_CYRILLIC = (
    f"cyrillic AS (SELECT doc_id AS id, translate(lower(text), {_sql(LATIN)}, {_sql(CYRILLIC)}) AS comment "
    "FROM documents)"
)
