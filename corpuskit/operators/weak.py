"""Weak labels from a lexicon: one projection, one regex per label."""

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.lexicon import UKRAINIAN
from corpuskit.operators.profile import describe
from corpuskit.schema import LABELS

_REFERS_BACK = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)")
RULED_LABELS = ["obscene", "insult", "identity_hate", "threat"]


def lexicon_rows(lexicon) -> list[tuple[str, str, str]]:
    """Accepts (label, kind, value) tuples or a table of them; a lexicon is configuration-sized."""
    if isinstance(lexicon, DataFrame):
        lexicon = lexicon.select("label", "kind", "value").toLocalIterator()
    rows = [tuple(row) for row in lexicon]
    kinds = {kind for _, kind, _ in rows} - {"word", "pattern"}
    if kinds:
        raise ValueError(f"unknown lexicon kinds: {sorted(kinds)}")
    return rows


def _escape(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|&~#-])", r"\\\1", word)


def alternation(parts: list[str]) -> str:
    """One regex that finds any of the parts.

    Parts are grouped by their first character, and word boundaries are tested
    only where such a character follows: most positions of a text are dismissed
    by a few character comparisons.
    """
    inner: dict[str, list[str]] = {}
    bounded: dict[str, list[str]] = {}
    rest = []
    for part in dict.fromkeys(parts):
        body = part.removeprefix(r"\b")
        groups = inner if body == part else bounded
        if re.match(r"\w(?![?*+{])", body) and "|" not in body:
            groups.setdefault(body[0], []).append(body[1:])
        else:
            rest.append(f"(?:{part})")
    join = lambda groups: "|".join(f"{c}(?:{'|'.join(tails)})" for c, tails in groups.items())
    out = [join(inner)] if inner else []
    if bounded:
        out.append(f"(?=[{''.join(bounded)}])\\b(?:{join(bounded)})")
    return "|".join(out + rest)


def contains_vocab(text: Column, words: list[str] = (), patterns: list[str] = ()) -> Column:
    """1 if the lower-cased text contains a word anywhere or matches a pattern.

    Patterns that refer back to their own groups are searched one by one, since joining
    patterns renumbers groups; all others form one expression.
    """
    alone = [p for p in patterns if _REFERS_BACK.search(p)]
    parts = [_escape(w) for w in words] + [p for p in patterns if not _REFERS_BACK.search(p)]
    joined = ([alternation(parts)] if parts else []) + alone
    if not joined:
        return F.lit(0)
    found = reduce(or_, [F.lower(text).rlike("(?U)(?d)" + p) for p in joined])
    return F.when(found, 1).otherwise(0)


def rule_label(text: Column, label: str, lexicon=UKRAINIAN) -> Column:
    mine = [(kind, value) for name, kind, value in lexicon_rows(lexicon) if name == label]
    words = [value for kind, value in mine if kind == "word"]
    return contains_vocab(text, words, [value for kind, value in mine if kind == "pattern"])


def severe_from_rules() -> Column:
    """Obscene together with a threat, an insult or identity hate."""
    other = (F.col("threat") == 1) | (F.col("insult") == 1) | (F.col("identity_hate") == 1)
    return F.when((F.col("obscene") == 1) & other, 1).otherwise(0)


def toxic_from_rules() -> Column:
    """Any other label."""
    return F.when(reduce(or_, [F.col(c) == 1 for c in LABELS[1:]]), 1).otherwise(0)


def weak_label(df: DataFrame, lexicon=UKRAINIAN, text: str = "comment", row_id: str = "id") -> DataFrame:
    """id and the six labels; the derived labels read the rule columns of an inner projection."""
    rows = lexicon_rows(lexicon)
    lower = df.select(row_id, F.lower(text).alias("__text"))
    ruled = lower.select(row_id, *[rule_label(F.col("__text"), c, rows).alias(c) for c in RULED_LABELS])
    severe = ruled.withColumn("severe_toxic", severe_from_rules())
    return severe.withColumn("toxic", toxic_from_rules()).select(row_id, *LABELS)


def describe_labels(labelled: DataFrame) -> DataFrame:
    return describe(labelled, LABELS)
