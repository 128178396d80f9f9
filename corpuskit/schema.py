"""Vocabularies, table schemas and configuration values shared by all operators."""

from pyspark.sql import types as T

# --- Fixed values: label, identity and threshold vocabularies -----------------
LABELS = ["toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate"]
PRIMARY_LABEL = "toxic"
TEXT_COL = "comment"

IDENTITIES = [
    "male",
    "female",
    "homosexual_gay_or_lesbian",
    "christian",
    "jewish",
    "muslim",
    "black",
    "white",
    "psychiatric_or_mental_illness",
]

LABEL_NAMES_UK = {
    "toxic": "токсичний",
    "severe_toxic": "дуже токсичний",
    "obscene": "нецензурний",
    "threat": "погроза",
    "insult": "образа",
    "identity_hate": "мова ворожнечі",
}

DEFAULT_THRESHOLDS = {
    "toxic": 0.5,
    "severe_toxic": 0.4,
    "obscene": 0.6,
    "threat": 0.6,
    "insult": 0.5,
    "identity_hate": 0.4,
}

# column names of the fractional corpus -> names used everywhere else
FRACTIONAL_TO_LABEL = {
    "target": "toxic",
    "toxicity": "toxic",
    "severe_toxicity": "severe_toxic",
    "identity_attack": "identity_hate",
}

FRACTIONAL_LABELS = ["target", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"]
# ------------------------------------------------------------------------------


def _struct(text_cols, int_cols=(), double_cols=()):
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text_cols]
        + [T.StructField(c, T.IntegerType()) for c in int_cols]
        + [T.StructField(c, T.DoubleType()) for c in double_cols]
    )


TOXIC_COMMENTS = _struct(["id", "comment_text"], LABELS)
TOXIC_TEXTS = _struct(["id", "comment_text"])
TOXIC_LABELS = _struct(["id"], LABELS)
BIAS_COMMENTS = _struct(["id", "comment_text"], double_cols=FRACTIONAL_LABELS + IDENTITIES)
TRANSLATIONS = _struct(["id", "translated"])
LEXICON = _struct(["label", "kind", "value"])
