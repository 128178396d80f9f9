"""Text cleaning as Column functions, and the configurable cleaning chain.

Patterns run on Java's regex engine.  ``(?U)`` gives Unicode ``\\w \\s \\d \\b``;
``(?d)`` makes ``.`` and ``^`` stop at ``\\n`` only.
"""

import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text_udf

# --- Fixed values: patterns that define what each step removes or replaces ----
MENTION = r"(?<!\w)@\w+"
HASHTAG = r"#\w+"
TAG = r"<[^>]+>"
REPEATED_CHAR = r"(.)\1{2,}"
URL = r"https?:\/\/\S+|www\.\S+"
EMAIL = r"\S+@\S+\.\S+"
PHONE = r"(\+?\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}"
WIKI_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
WIKI_SIGNATURE = r"\b\d{1,2}:\d{2},\s+[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\s*\(UTC\)"
WIKI_TEMPLATE = r"\{\{.*?\}\}"
WIKI_LINK = r"\[\[.*?\]\]"
WIKI_INDENT = r"^:+"
USER_REMNANT = r"\S+\[USER\]\S*\.\w+"
# ------------------------------------------------------------------------------

# A look-ahead in front of a pattern names the characters it can start with, so
# nearly all positions of a text are dismissed by one comparison.

# Java does not count U+001C..U+001F as white space, Python does
_SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"[^\s\x1c-\x1f]"
_WIKI_FLAGS = "(?iumdU)"


def remove_wiki_elements(text: Column) -> Column:
    """IPs, signature timestamps, templates, links and leading colons become one space."""
    for start, pattern in (
        (r"(?=\d)", WIKI_IP),
        (r"(?=\d)", WIKI_SIGNATURE),
        ("", WIKI_TEMPLATE),
        ("", WIKI_LINK),
        ("(?=:)", WIKI_INDENT),
    ):
        text = F.regexp_replace(text, _WIKI_FLAGS + start + pattern, " ")
    return text


def handle_mentions(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)(?=@)" + MENTION, "[USER]")


def remove_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + HASHTAG, "")


def remove_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAG, "")


def reduce_repetitions(text: Column) -> Column:
    """Three or more equal characters in a row become two (never newlines)."""
    return F.regexp_replace(text, "(?d)" + REPEATED_CHAR, "$1$1")


def _replace_emails(text: Column) -> Column:
    # an address always takes its whole token, so only token starts need trying, and
    # most texts have no address at all; the guard reads its input no extra time, as
    # Spark evaluates an expression shared by a condition and its branches once
    replaced = F.regexp_replace(text, r"(?U)(?<!\S)" + EMAIL, "[EMAIL]")
    return F.when(text.contains("@"), replaced).otherwise(text)


def _replace_urls(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)(?=[hw])(?:{URL})", "[URL]")


def handle_urls_emails(text: Column) -> Column:
    return _replace_emails(_replace_urls(text))


def handle_phone_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(?=[+(\d])" + PHONE, "[PHONE]")


def remove_newlines_and_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){_SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


@lru_cache(maxsize=1)
def _nonprintable_class() -> str:
    """Character class of every code point Python calls non-printable, built by rule."""
    ranges, start = [], None
    for code in range(0x110001):
        hidden = code < 0x110000 and not chr(code).isprintable()
        if hidden and start is None:
            start = code
        elif not hidden and start is not None:
            ranges.append(rf"\x{{{start:x}}}-\x{{{code - 1:x}}}")
            start = None
    return "[" + "".join(ranges) + "]"


def remove_nonprintable(text: Column) -> Column:
    """Drop control, format, unassigned and separator characters except the plain space.

    The cheap class decides for nearly every character; the exact ranges keep
    characters that are newer than the JVM's Unicode tables.
    """
    return F.regexp_replace(text, r"(?=[\p{C}\p{Z}&&[^ ]])" + _nonprintable_class(), "")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def _only_where(condition: Column, text: Column, step) -> Column:
    """Run an Arrow UDF on the rows that need it; the other rows travel as nulls."""
    return F.when(condition, step(F.when(condition, text))).otherwise(text)


def _ranges(codes) -> str:
    """A Java character class of the code points."""
    spans = []
    for code in sorted(codes):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


# characters of everyday Latin and Cyrillic text; none of them takes part in NFC or is an emoji
_PLAIN = r"[\x{0}-\x{a8}\x{aa}-\x{ad}\x{af}-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{203b}]"


@lru_cache(maxsize=1)
def _composable_class() -> str:
    """Every character that NFC may change or join to the one before it, by rule."""
    codes = set()
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        if unicodedata.combining(char) or not unicodedata.is_normalized("NFC", char):
            codes.add(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and unicodedata.is_normalized("NFC", char):
            codes.update(map(ord, parts[1:]))  # a later part of a composed character
    return _ranges(codes)


@lru_cache(maxsize=1)
def _emoji_class() -> str:
    return _ranges([*text_udf.emoji_code_points(), ord(text_udf.KEY_CAP)])


def needs_nfc(text: Column) -> Column:
    """True where NFC could change anything; precomposed Latin and Cyrillic text is false."""
    return text.rlike(f"(?!{_PLAIN}){_composable_class()}")


def has_emoji(text: Column) -> Column:
    """True where the emoji step could change anything."""
    return text.rlike(f"(?!{_PLAIN}){_emoji_class()}")


def normalize_unicode(text: Column) -> Column:
    return _only_where(needs_nfc(text), text, text_udf.arrow_steps(["nfc"]))


def convert_emojis_to_text(text: Column, names: dict | None = None) -> Column:
    """Emoji become ``:name:``; ``names`` maps emoji sequences to names.

    Without ``names`` the Unicode character names are used; flags, key caps, skin tones and joined
    emoji are one name each.
    """
    step = text_udf.arrow_steps(["emoji"], names)
    if names is not None:
        return step(text)
    return _only_where(has_emoji(text), text, step)


def remove_repetitive_chunks(text: Column, max_repeats: int = 2) -> Column:
    """Collapse a unit that is repeated more than ``max_repeats`` times in a row to one."""
    return F.coalesce(text_udf.arrow_steps(["chunks"], max_repeats=max_repeats)(text), F.lit(""))


def remove_repeated_sentences(text: Column) -> Column:
    """Keep the first of each sentence, ignoring case; sentences are joined by one space."""
    sentences = F.split(text, r"(?<=[.!?]) +")
    distinct = F.array_distinct(F.transform(sentences, F.lower))
    repeats = F.size(distinct) < F.size(sentences)
    step = text_udf.arrow_steps(["sentences"])
    return F.when(repeats, step(F.when(repeats, text))).otherwise(F.array_join(sentences, " "))


def sanitize_translation(text: Column) -> Column:
    """Double quotes become single ones and the text a single trimmed line."""
    return remove_newlines_and_whitespace(F.translate(text, '"', "'"))


def strip_code_fences(text: Column) -> Column:
    bare = strip(text)
    opened = F.regexp_replace(bare, r"(?d)\A```[a-zA-Z]*\n?", "")
    closed = F.regexp_replace(opened, r"(?d)\n?```$", "")
    return F.when(bare.startswith("```"), strip(closed)).otherwise(bare)


def scrub_pii(text: Column) -> Column:
    """Drop remnants of masked addresses, then mask links, e-mails and phone numbers."""
    text = F.regexp_replace(text, "(?U)" + USER_REMNANT, "")
    return handle_phone_numbers(handle_urls_emails(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){_NOT_SPACE}+")).cast("int")


# --- Fixed values: default switches of the cleaning chain ---------------------
DEFAULT_FLAGS = {
    "remove_urls_and_emails": True,
    "remove_tags": True,
    "remove_mentions": True,
    "remove_hashtags": True,
    "remove_phone_numbers": True,
    "convert_emojis": True,
    "lowercase": False,
    "remove_newlines_and_spaces": True,
    "remove_nonprintable_characters": False,
    "remove_repeated_sentences": False,
    "remove_repeated_chunks": False,
    "reduce_repetitions": True,
    "normalize_unicode": True,
    "remove_wiki_elements": False,
}
TRANSLATION_PRESET = {
    "remove_wiki_elements": True,
    "remove_nonprintable_characters": True,
    "remove_repeated_sentences": True,
    "remove_repeated_chunks": True,
}
MODEL_PRESET = {"lowercase": True}
# ------------------------------------------------------------------------------


def _flags(given: dict) -> dict:
    unknown = set(given) - set(DEFAULT_FLAGS)
    if unknown:
        raise ValueError(f"unknown cleaning flags: {sorted(unknown)}")
    return {**DEFAULT_FLAGS, **given}


def clean_text(
    df: DataFrame,
    column: str,
    emoji_names: dict | None = None,
    spaces_before_nonprintable: bool = False,
    **flags,
) -> DataFrame:
    """Replace ``column`` by its cleaned text; the order of the steps is fixed.

    Every step reads its input once, so the chain stays one linear expression
    even when Catalyst copies it into a filter.  ``spaces_before_nonprintable``
    turns line breaks into spaces before they are removed, so words are not joined.
    """
    on = _flags(flags)
    head = [
        (on["remove_wiki_elements"], remove_wiki_elements),
        (on["remove_tags"], remove_tags),
        (on["remove_hashtags"], remove_hashtags),
        (on["remove_urls_and_emails"], handle_urls_emails),
        (on["remove_phone_numbers"], handle_phone_numbers),
        (on["remove_mentions"], handle_mentions),
    ]
    text = F.col(column)
    for switch, step in head:
        text = step(text) if switch else text
    df = df.withColumn(column, text)

    middle = [
        name
        for name, switch in (
            ("emoji", on["convert_emojis"]),
            ("lower", on["lowercase"]),
            ("chunks", on["remove_repeated_chunks"]),
            ("sentences", on["remove_repeated_sentences"]),
            ("repetitions", on["reduce_repetitions"]),
            ("nfc", on["normalize_unicode"]),
        )
        if switch
    ]
    text = F.col(column)
    if {"chunks", "sentences"} & set(middle) or (emoji_names is not None and "emoji" in middle):
        # one Arrow round trip for the whole run of steps, never repeated for a later filter; sentences cost less
        # in it than as arrays of strings in the JVM
        df = df.withColumn(column, text_udf.arrow_steps(middle, emoji_names, once=True)(text))
    else:
        df = _middle_in_jvm(df, column, middle)

    if on["remove_nonprintable_characters"]:
        if spaces_before_nonprintable:
            text = F.regexp_replace(text, f"(?U){_SPACE}+", " ")
        text = remove_nonprintable(text)
    text = remove_newlines_and_whitespace(text) if on["remove_newlines_and_spaces"] else strip(text)
    return df.withColumn(column, text)


def _middle_in_jvm(df: DataFrame, column: str, middle: list[str]) -> DataFrame:
    """Rows without emoji or composable characters stay in the JVM; the rest take one Arrow round trip."""
    text = F.col(column)
    jvm = {"lower": lowercase, "repetitions": reduce_repetitions}
    narrow = text
    for name in middle:
        narrow = jvm[name](narrow) if name in jvm else narrow
    if not {"emoji", "nfc"} & set(middle):
        return df.withColumn(column, narrow)
    tests = [test(text) for name, test in (("emoji", has_emoji), ("nfc", needs_nfc)) if name in middle]
    wide = reduce(or_, tests)
    done = text_udf.arrow_steps(middle)(F.when(wide, text))
    return df.withColumn(column, F.when(wide, done).otherwise(narrow))


def clean_for_translation(df: DataFrame, column: str = "comment_text", **options) -> DataFrame:
    """Heavy cleaning before translation: missing text counts as empty, blank rows go."""
    df = df.withColumn(column, F.coalesce(F.col(column), F.lit("")))
    df = clean_text(df, column, **{**TRANSLATION_PRESET, **options})
    # a plain filter would be pushed below the chain and evaluate it a second time; an array of no or one text is not
    kept = F.filter(F.array(column), lambda text: ~text.rlike(rf"(?U)\A{_SPACE}*\z"))
    return df.withColumn(column, F.explode(kept))


def clean_for_model(df: DataFrame, column: str = "comment", **options) -> DataFrame:
    """Light normalisation used for training and inference."""
    return clean_text(df, column, **{**MODEL_PRESET, **options})
