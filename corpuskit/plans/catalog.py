"""Registered queries: every operator over whole given tables, with its comparison SQL.

``query(name, sql)`` registers a callable (spark, folder) -> DataFrame.  Queries
without SQL cannot be expressed in the comparison engine and are tested against
brute force in ``tests/``.
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text
from corpuskit.functions.lexicon import UKRAINIAN
from corpuskit.operators import batch, evaluate, profile, project, sample, score, setops, train, weak
from corpuskit.plans import fixtures as fx
from corpuskit.plans import jobs
from corpuskit.schema import DEFAULT_THRESHOLDS, IDENTITIES, LABEL_NAMES_UK, LABELS, TOXIC_TEXTS
from corpuskit.session import freeze, scratch_path
from corpuskit.sources import tables
from corpuskit.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def _key(column: str = "id", seed=SEED) -> str:
    return f"md5(concat_ws(':', '{seed}', {column}))"


C = _with(fx.SQL_COMMENTS)
S = _with(fx.SQL_SCORES)
L = _with(fx.SQL_SCORES, fx.SQL_LONG)
DECORATED = _with(fx.SQL_DECORATED)
ANY_LABEL = "greatest(" + ", ".join(LABELS) + ")"
ANY_IDENTITY = "greatest(" + ", ".join(IDENTITIES) + ")"


# ------------------------------------------------------------------ sources ---
@query("read_table", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS comment FROM documents")
def _(spark, d):
    rows = tables.read_comments(spark, f"{d}/documents.parquet")
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment"))


@query("write_csv_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS comment_text FROM documents")
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment_text"))
    path = scratch_path(spark, "roundtrip") + ".csv"
    tables.write_table(rows, path)
    return tables.read_or_empty(spark, path, TOXIC_TEXTS)


@query("read_or_empty", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    stored = fx.table(spark, d, "labels")
    absent = tables.read_or_empty(spark, scratch_path(spark, "absent"), stored.schema)
    return setops.union_same(absent, tables.read_or_empty(spark, f"{d}/labels.parquet", stored.schema))


@query("row_ids", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS id FROM documents")
def _(spark, d):
    return tables.with_row_id(fx.documents(spark, d).select("doc_id", "lang"), ["lang", "doc_id"]).drop("lang")


@query("rewrite_stage", "SELECT doc_id, CAST(1 - toxic AS INT) AS toxic FROM labels")
def _(spark, d):
    path = scratch_path(spark, "stage")
    tables.write_table(fx.table(spark, d, "labels"), path)
    stage = tables.read_comments(spark, path)
    return tables.rewrite_stage(stage.select("doc_id", (1 - F.col("toxic")).cast("int").alias("toxic")), path)


# --------------------------------------------------------------- projection ---
@query("select_columns", C + "SELECT id, comment_text, toxic FROM comments")
def _(spark, d):
    return project.select_cols(fx.comments(spark, d), ["id", "comment_text", "toxic"])


@query("keep_only", C + f"SELECT id, {', '.join(LABELS)} FROM comments")
def _(spark, d):
    return project.keep_only(fx.comments(spark, d), ["id", *LABELS, "absent"])


@query("align_names", C + "SELECT id, comment_text AS comment, identity_hate AS identity_attack FROM comments")
def _(spark, d):
    names = {"comment_text": "comment", "identity_hate": "identity_attack", "absent": "x"}
    return project.align_names(fx.comments(spark, d), names).select("id", "comment", "identity_attack")


@query("add_missing", "SELECT doc_id, toxic, " + ", ".join(f"0 AS {c}" for c in IDENTITIES) + " FROM labels")
def _(spark, d):
    rows = fx.table(spark, d, "labels").select("doc_id", "toxic")
    return project.add_missing(rows, ["toxic", *IDENTITIES])


@query("binarize_scores", C + "SELECT id, CASE WHEN target >= 0.5 THEN 1 ELSE 0 END AS target FROM comments")
def _(spark, d):
    return project.binarize(fx.comments(spark, d), ["target"]).select("id", "target")


@query(
    "drop_unlabelled",
    C + "SELECT id, marked AS toxic, insult FROM (SELECT *, CASE WHEN id % 6 = 0 THEN -1 ELSE toxic END AS marked "
    "FROM comments) WHERE marked <> -1 AND insult <> -1",
)
def _(spark, d):
    marked = F.when(F.col("id") % 6 == 0, -1).otherwise(F.col("toxic"))
    rows = fx.comments(spark, d).withColumn("toxic", marked)
    return project.drop_unlabelled(rows).select("id", "toxic", "insult")


@query("drop_null_text", C + "SELECT id, target FROM comments WHERE target IS NOT NULL")
def _(spark, d):
    return project.drop_null_text(fx.comments(spark, d).select("id", "target"), "target")


@query(
    "drop_blank",
    C + "SELECT id, comment_text FROM comments WHERE label_count > 0 AND NOT regexp_full_match(comment_text, '\\s*')",
)
def _(spark, d):
    blank = F.when(F.col("label_count") == 0, F.lit(" \n\t")).otherwise(F.col("comment_text"))
    rows = fx.comments(spark, d).withColumn("comment_text", blank)
    return project.drop_blank(rows).select("id", "comment_text")


@query("row_counts", C + "SELECT id, label_count, category_count FROM comments")
def _(spark, d):
    return fx.comments(spark, d).select("id", "label_count", "category_count")


@query(
    "corpus_segments",
    C + "SELECT id, CASE WHEN label_count > 0 THEN 'toxic' WHEN category_count > 0 THEN 'identity' ELSE 'plain' END "
    "AS segment FROM comments",
)
def _(spark, d):
    return project.corpus_segment(fx.comments(spark, d)).select("id", "segment")


STRATUM_SQL = (
    f"CASE WHEN {ANY_LABEL} > 0 THEN 'toxic_' ELSE 'clean_' END || "
    f"CASE WHEN {ANY_IDENTITY} > 0 THEN 'identity' ELSE 'plain' END"
)


@query("strata", C + f"SELECT id, {STRATUM_SQL} AS stratum FROM comments")
def _(spark, d):
    return fx.comments(spark, d).select("id", project.stratum().alias("stratum"))


@query(
    "plain_filter",
    C + "SELECT id FROM comments WHERE comment_length <= 400 AND NOT contains(lower(comment_text), 'ouen')",
)
def _(spark, d):
    return project.plain_filter(fx.comments(spark, d), 400, "Ouen").select("id")


@query(
    "seed_keep",
    C + "SELECT id, CASE WHEN label_count > 3 OR severe_toxic = 1 OR threat = 1 THEN 1 ELSE 0 END AS keep FROM comments",
)
def _(spark, d):
    return project.seed_keep(fx.comments(spark, d)).select("id", "keep")


@query(
    "null_report",
    C + "SELECT 'id' AS column_name, count(*) FILTER (id IS NULL) AS nulls FROM comments UNION ALL "
    "SELECT 'comment_text', count(*) FILTER (comment_text IS NULL) FROM comments UNION ALL "
    "SELECT 'target', count(*) FILTER (target IS NULL) FROM comments",
)
def _(spark, d):
    return project.null_report(fx.comments(spark, d).select("id", "comment_text", "target"))


# ------------------------------------------------------------- text cleaning ---
_MENTION_SQL = r"regexp_replace({}, '(^|[^\w\p{{L}}\p{{N}}])@[\w\p{{L}}\p{{N}}]+', '\1[USER]', 'g')"
_HASHTAG_SQL = r"regexp_replace({}, '#[\w\p{{L}}\p{{N}}]+', '', 'g')"
_TAG_SQL = "regexp_replace({}, '<[^>]+>', '', 'g')"
_URL_SQL = r"regexp_replace({}, 'https?:\/\/\S+|www\.\S+', '[URL]', 'g')"
_EMAIL_SQL = r"regexp_replace({}, '\S+@\S+\.\S+', '[EMAIL]', 'g')"
_PHONE_SQL = (
    r"regexp_replace({}, '(\+?\d{{1,2}}\s?)?\(?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{2}}[\s.-]?\d{{2}}', '[PHONE]', 'g')"
)
_SPACE_SQL = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_WIKI_SQL = "{}"
for _pattern in (
    r"\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}",
    r"\b\d{{1,2}}:\d{{2}},\s+[A-Z][a-z]+\s+\d{{1,2}},\s+\d{{4}}\s*\(UTC\)",
    r"\{{\{{.*?\}}\}}",
    r"\[\[.*?\]\]",
    "^:+",
):
    _WIKI_SQL = f"regexp_replace({_WIKI_SQL}, '(?im){_pattern}', ' ', 'g')"
_REPETITION_CTE = (
    "SELECT doc_id, array_to_string(list_filter(a, lambda x, i: NOT (i > 2 AND x <> chr(10) AND x = a[i - 1] "
    "AND x = a[i - 2])), '') AS cleaned FROM (SELECT doc_id, string_split({}, '') AS a FROM {})"
)


def _cleaned(rows: DataFrame, column: Column, key: str = "doc_id") -> DataFrame:
    return rows.select(key, column.alias("cleaned"))


def _on_decorated(name: str, step, sql: str):
    @query(name, DECORATED + f"SELECT doc_id, {sql.format('t')} AS cleaned FROM decorated")
    def _(spark, d):
        return _cleaned(fx.decorated(spark, d), step(F.col("t")))


_on_decorated("clean_mentions", text.handle_mentions, _MENTION_SQL)
_on_decorated("clean_hashtags", text.remove_hashtags, _HASHTAG_SQL)
_on_decorated("clean_urls", text.handle_urls_emails, _EMAIL_SQL.format(_URL_SQL))
_on_decorated("clean_phones", text.handle_phone_numbers, _PHONE_SQL)
_on_decorated("clean_whitespace", text.remove_newlines_and_whitespace, _SPACE_SQL)
_on_decorated("clean_lowercase", text.lowercase, "lower({})")


@query(
    "clean_wiki",
    f"SELECT doc_id, {_WIKI_SQL.format(_quoted(fx.WIKI_PREFIX) + ' || text')} AS cleaned FROM documents",
)
def _(spark, d):
    rows = fx.documents(spark, d)
    return _cleaned(rows, text.remove_wiki_elements(F.concat(F.lit(fx.WIKI_PREFIX), F.col("text"))))


@query("clean_tags", f"SELECT page_id, {_TAG_SQL.format('html')} AS cleaned FROM pages")
def _(spark, d):
    return _cleaned(fx.table(spark, d, "pages"), text.remove_tags(F.col("html")), "page_id")


@query("clean_repetitions", _REPETITION_CTE.format("text", "documents"))
def _(spark, d):
    return _cleaned(fx.documents(spark, d), text.reduce_repetitions(F.col("text")))


@query("clean_repeated_chunks")
def _(spark, d):
    return _cleaned(fx.documents(spark, d), text.remove_repetitive_chunks(F.col("text")))


_SENTENCES_SQL = (
    "SELECT doc_id, array_to_string(list_filter(s, lambda x, i: list_position(low, lower(x)) = i), ' ') AS cleaned "
    "FROM (SELECT doc_id, s, list_transform(s, lambda x: lower(x)) AS low FROM (SELECT doc_id, "
    "string_split(regexp_replace(text, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents))"
)


@query("clean_repeated_sentences", _SENTENCES_SQL)
def _(spark, d):
    return _cleaned(fx.documents(spark, d), text.remove_repeated_sentences(F.col("text")))


EMOJI_NAMES = {"😀": "grinning_face", "👍": "thumbs_up", "👍🏽": "thumbs_up_medium_skin_tone", "❤️": "red_heart"}


@query(
    "clean_emoji",
    "SELECT doc_id, replace(replace(replace(replace(text || ' 😀 👍🏽👍 ❤️', '👍🏽', ':thumbs_up_medium_skin_tone:'), "
    "'👍', ':thumbs_up:'), '😀', ':grinning_face:'), '❤️', ':red_heart:') AS cleaned FROM documents",
)
def _(spark, d):
    joyful = F.concat(F.col("text"), F.lit(" 😀 👍🏽👍 ❤️"))
    return _cleaned(fx.documents(spark, d), text.convert_emojis_to_text(joyful, EMOJI_NAMES))


EMOJI_SAMPLE = " \U0001f44d\U0001f3fd \U0001f468\u200d\U0001f469\u200d\U0001f467 \U0001f1fa\U0001f1e6 1\ufe0f\u20e3 ™ ℹ ❤️ ✓"
EMOJI_SAMPLE_NAMES = (
    " :thumbs_up_sign_medium_skin_tone: :man_woman_girl: :flag_ua: :keycap_1: :trade_mark_sign: :information_source: "
    ":heavy_black_heart: ✓"
)


@query("clean_emoji_default", f"SELECT doc_id, concat(text, {_quoted(EMOJI_SAMPLE_NAMES)}) AS cleaned FROM documents")
def _(spark, d):
    return _cleaned(fx.documents(spark, d), text.convert_emojis_to_text(F.concat("text", F.lit(EMOJI_SAMPLE))))


@query(
    "clean_nonprintable",
    "SELECT doc_id, regexp_replace(concat(text, chr(8203), chr(173), chr(160), chr(8232), 'end'), "
    r"'[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g') AS cleaned FROM documents",
)
def _(spark, d):
    hidden = F.concat(F.col("text"), F.lit("​­  end"))
    return _cleaned(fx.documents(spark, d), text.remove_nonprintable(hidden))


@query("clean_nfc", "SELECT doc_id, nfc_normalize(concat(text, ' e', chr(769), ' a', chr(776))) AS cleaned FROM documents")
def _(spark, d):
    split = F.concat(F.col("text"), F.lit(" é ä"))
    return _cleaned(fx.documents(spark, d), text.normalize_unicode(split))


_CHAIN_INPUT = DECORATED + ", chained AS (SELECT doc_id, lower({}) AS t FROM decorated), "
_CHAIN_INNER = _MENTION_SQL.format(
    _PHONE_SQL.format(_EMAIL_SQL.format(_URL_SQL.format(_HASHTAG_SQL.format(_TAG_SQL.format("t")))))
)
_CHAIN_SQL = (
    _CHAIN_INPUT.format(_CHAIN_INNER)
    + f"reduced AS ({_REPETITION_CTE.format('t', 'chained')}) "
    + f"SELECT doc_id, {_SPACE_SQL.format('nfc_normalize(cleaned)')} AS cleaned FROM reduced"
)


@query("clean_chain", _CHAIN_SQL)
def _(spark, d):
    rows = text.clean_text(fx.decorated(spark, d), "t", lowercase=True, convert_emojis=False)
    return rows.withColumnRenamed("t", "cleaned")


@query("clean_model_preset", _CHAIN_SQL)
def _(spark, d):
    return text.clean_for_model(fx.decorated(spark, d), "t").withColumnRenamed("t", "cleaned")


_CYRILLIC_CHAIN_SQL = _CHAIN_SQL.replace(
    "text) AS t FROM documents)",
    f"translate(lower(text), {_quoted(fx.LATIN)}, {_quoted(fx.CYRILLIC)})) AS t FROM documents)",
)


@query("clean_model_preset_cyrillic", _CYRILLIC_CHAIN_SQL)
def _(spark, d):
    rows = fx.documents(spark, d)
    made = rows.select("doc_id", fx.decoration(F.translate(F.lower("text"), fx.LATIN, fx.CYRILLIC)).alias("t"))
    return text.clean_for_model(made, "t").withColumnRenamed("t", "cleaned")


@query("clean_translation_preset")
def _(spark, d):
    return text.clean_for_translation(fx.decorated(spark, d), "t").withColumnRenamed("t", "cleaned")


_SENTENCES_CTE = _SENTENCES_SQL.replace("AS cleaned", "AS t").replace("replace(text,", "replace(t,").replace("FROM documents", "FROM {}")
_HIDDEN_SQL = r"regexp_replace({}, '[\p{{C}}\p{{Zl}}\p{{Zp}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')"


def _translation_sql(source: str, key: str, column: str) -> str:
    """The translation preset without the step for repeated chunks, as CTEs that end in ``prepared``."""
    inner = _CHAIN_INNER.replace("regexp_replace(t,", f"regexp_replace({_WIKI_SQL.format(column)},")
    last = _SPACE_SQL.format(_HIDDEN_SQL.format("nfc_normalize(cleaned)"))
    return (
        f"chained AS (SELECT {key} AS doc_id, {inner} AS t FROM {source}), "
        f"once AS ({_SENTENCES_CTE.format('chained')}), reduced AS ({_REPETITION_CTE.format('t', 'once')}), "
        f"prepared AS (SELECT * FROM (SELECT doc_id, {last} AS cleaned FROM reduced) "
        r"WHERE NOT regexp_full_match(cleaned, '\s*'))"
    )


@query(
    "clean_translation_without_chunks",
    DECORATED + ", " + _translation_sql("decorated", "doc_id", "t") + " SELECT doc_id, cleaned FROM prepared",
)
def _(spark, d):
    """The translation preset up to its one step that SQL cannot express; the tests cover that step."""
    rows = fx.decorated(spark, d)
    return text.clean_for_translation(rows, "t", remove_repeated_chunks=False).withColumnRenamed("t", "cleaned")


def _scrub_sql(column: str) -> str:
    bare = rf"regexp_replace({column}, '\S+\[USER\]\S*\.\w+', '', 'g')"
    return _PHONE_SQL.format(_EMAIL_SQL.format(_URL_SQL.format(bare)))


@query("pii_scrub", DECORATED + "SELECT doc_id, " + _scrub_sql("t || ' me[USER]x.org'") + " AS cleaned FROM decorated")
def _(spark, d):
    return _cleaned(fx.decorated(spark, d), text.scrub_pii(F.concat("t", F.lit(" me[USER]x.org"))))


@query(
    "sanitize_translation",
    r"""SELECT doc_id, trim(regexp_replace(replace('"' || text || '"', '"', ''''), '\s+', ' ', 'g')) AS cleaned
    FROM documents""",
)
def _(spark, d):
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    return _cleaned(fx.documents(spark, d), text.sanitize_translation(quoted))


@query(
    "strip_fences",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    '```json' || chr(10) || text || chr(10) || '```', '^```[a-zA-Z]*\n?', ''), '\n?```$', ''), '^\s+', ''), '\s+$', '')
    AS cleaned FROM documents""",
)
def _(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return _cleaned(fx.documents(spark, d), text.strip_code_fences(fenced))


@query("word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS words FROM documents")
def _(spark, d):
    return fx.documents(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"))


# ------------------------------------------------------------ weak labelling ---
_WEAK = (
    "labelled AS (SELECT *, CASE WHEN severe_toxic + obscene + threat + insult + identity_hate > 0 THEN 1 ELSE 0 END "
    "AS toxic FROM (SELECT *, CASE WHEN obscene = 1 AND (threat = 1 OR insult = 1 OR identity_hate = 1) THEN 1 ELSE 0 "
    "END AS severe_toxic FROM (SELECT {id} AS id, {rules} FROM {source})))"
)


def _rules_sql(column: str, lexicon) -> str:
    """Rules as SQL; RE2 knows only ASCII word boundaries, so they are spelled out."""
    parts = []
    for label in weak.RULED_LABELS:
        mine = [(k, v) for name, k, v in lexicon if name == label]
        tests = [f"contains({column}, {_quoted(v)})" for k, v in mine if k == "word"]
        for k, v in mine:
            if k == "pattern":
                v = ("(?:^|[^\\w\\p{L}\\p{N}])" + v[2:]) if v.startswith("\\b") else v
                v = (v[:-2] + "(?:$|[^\\w\\p{L}\\p{N}])") if v.endswith("\\b") else v
                tests.append(f"regexp_matches({column}, {_quoted(v)})")
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END AS {label}")
    return ", ".join(parts)


WEAK_DOCUMENTS = _WEAK.format(id="doc_id", rules=_rules_sql("lower(text)", fx.LEXICON), source="documents")
LABEL_LIST = ", ".join(LABELS)


def _weak_documents(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    return weak.weak_label(rows, fx.LEXICON)


@query("weak_labels", _with(WEAK_DOCUMENTS) + f"SELECT id, {LABEL_LIST} FROM labelled")
def _(spark, d):
    return _weak_documents(spark, d)


@query(
    "weak_labels_builtin",
    _with(fx.SQL_CYRILLIC, _WEAK.format(id="id", rules=_rules_sql("comment", UKRAINIAN), source="cyrillic"))
    + f"SELECT id, {LABEL_LIST} FROM labelled",
)
def _(spark, d):
    return weak.weak_label(fx.cyrillic(spark, d))


@query(
    "contains_vocab",
    "SELECT doc_id, CASE WHEN contains(lower(text), 'the.') OR contains(lower(text), 'eaux') OR "
    "regexp_matches(lower(text), '\\sand\\s.?o') THEN 1 ELSE 0 END AS hit FROM documents",
)
def _(spark, d):
    hit = weak.contains_vocab(F.col("text"), ["the.", "eaux"], [r"\sand\s.?o"])
    return fx.documents(spark, d).select("doc_id", hit.alias("hit"))


_PROFILE_TEXT = _SPACE_SQL.format("lower(" + _PHONE_SQL.format(_EMAIL_SQL.format(_URL_SQL.format("text"))) + ")")


@query(
    "weak_label_profile",
    _with(
        f"cleaned AS (SELECT doc_id, {_PROFILE_TEXT} AS t FROM documents)",
        _WEAK.format(id="doc_id", rules=_rules_sql("lower(t)", fx.LEXICON), source="cleaned"),
    )
    + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER ({c} = 1) AS n FROM labelled" for c in LABELS),
)
def weak_label_profile(spark, d):
    """Flagship: scan, clean, weak-label and profile in one plan with a single tiny shuffle."""
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    only = {flag: False for flag in text.DEFAULT_FLAGS}
    only.update(remove_urls_and_emails=True, remove_phone_numbers=True, lowercase=True, remove_newlines_and_spaces=True)
    cleaned = text.clean_text(rows, "comment", **only)
    return profile.category_distribution(weak.weak_label(cleaned, fx.LEXICON))


def _describe_sql(column: str, source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    v = f"CAST({column} AS DOUBLE)"
    return (
        f"SELECT {head}'{column}' AS column_name, count({column}) AS n, round(avg({v}), 6) AS mean, "
        f"round(stddev_samp({v}), 6) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), 6) AS p25, "
        f"round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75, max({v}) AS max "
        f"FROM {source}" + (f" GROUP BY {by}" if by else "")
    )


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_STATS = ("mean", "std", "p25", "p50", "p75")


@query(
    "describe_labels",
    _with(WEAK_DOCUMENTS) + " UNION ALL ".join(_describe_sql(c, "labelled") for c in LABELS),
)
def _(spark, d):
    return _rounded(weak.describe_labels(_weak_documents(spark, d)), *_STATS)


# --------------------------------------------------------- joins, unions, dedup ---
@query(
    "join_labels",
    "SELECT d.doc_id AS id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), "lang")
    return setops.join_on_id(rows, fx.table(spark, d, "labels").withColumnRenamed("doc_id", "id"))


TRANSLATED = _with(fx.SQL_TRANSLATIONS, fx.SQL_COMMENTS)


@query(
    "join_translations",
    TRANSLATED + "SELECT t.id, t.translated, c.comment_length, c.toxic FROM translations t JOIN comments c ON t.id = c.id",
)
def _(spark, d):
    source = fx.comments(spark, d).select("id", "comment_length", "toxic")
    return setops.join_on_id(fx.translations(spark, d), source)


@query(
    "semi_translated",
    TRANSLATED + "SELECT id, translated FROM translations WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
)
def _(spark, d):
    english = fx.documents(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return setops.in_source(fx.translations(spark, d), english)


@query(
    "anti_untranslated",
    TRANSLATED + "SELECT id, comment_text FROM comments WHERE id NOT IN (SELECT id FROM translations)",
)
def _(spark, d):
    rows = fx.comments(spark, d).select("id", "comment_text")
    return setops.not_in_source(rows, fx.translations(spark, d))


@query(
    "holdout_removal",
    C + "SELECT 'rest' AS part, id FROM comments WHERE threat = 0 UNION ALL "
    "SELECT 'balanced', id FROM comments WHERE insult = 1 AND threat = 0",
)
def _(spark, d):
    rows = fx.comments(spark, d)
    selected = rows.where("threat = 1").select("id")
    rest, balanced = setops.remove_holdout(
        selected, rows.select("id"), [rows.select("id"), rows.where("insult = 1").select("id")]
    )
    return setops.union_same(
        rest.select(F.lit("rest").alias("part"), "id"), balanced.select(F.lit("balanced").alias("part"), "id")
    )


@query("complement", C + "SELECT id, toxic FROM comments WHERE id NOT IN (SELECT id FROM comments WHERE obscene = 1)")
def _(spark, d):
    rows = fx.comments(spark, d).select("id", "toxic", "obscene")
    return setops.not_in_source(rows, rows.where("obscene = 1")).drop("obscene")


@query("union_same", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def _(spark, d):
    docs = fx.documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    return setops.union_same(docs, fx.table(spark, d, "benchmark").select("text", F.col("item_id").alias("id")))


@query(
    "union_missing",
    "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages",
)
def _(spark, d):
    docs = fx.documents(spark, d).select(F.col("doc_id").alias("id"), "lang")
    return setops.union_missing(docs, fx.table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"))


@query(
    "dedup_first",
    "SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r "
    "FROM documents) WHERE r = 1",
)
def _(spark, d):
    return setops.dedup_first(fx.documents(spark, d).select("doc_id", "lang", "text"), "text", ["doc_id"])


@query(
    "upsert_existing_wins",
    _with(fx.SQL_TRANSLATIONS)
    + "SELECT id, translated FROM translations UNION ALL SELECT doc_id, text FROM documents "
    "WHERE doc_id NOT IN (SELECT id FROM translations)",
)
def _(spark, d):
    new = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("translated"))
    return setops.upsert(fx.translations(spark, d), new)


# ---------------------------------------------------------------- profiling ---
@query("shape", C + f"SELECT count(*) AS n_rows, {5 + len(LABELS) + len(IDENTITIES) + 1} AS n_columns FROM comments")
def _(spark, d):
    return profile.shape(fx.comments(spark, d))


@query(
    "count_where",
    C + "SELECT count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (target >= 0.5) AS high, "
    "count(*) FILTER (target < 0.5) AS low FROM comments",
)
def _(spark, d):
    target = F.col("target")
    conditions = {"toxic": F.col("toxic") == 1, "high": target >= 0.5, "low": target < 0.5}
    return profile.count_where(fx.comments(spark, d), conditions)


@query(
    "inconsistent_count",
    C + f"SELECT count(*) FILTER (toxic = 0 AND {' + '.join(LABELS[1:])} > 0) AS inconsistent FROM comments",
)
def _(spark, d):
    return profile.inconsistent_count(fx.comments(spark, d))


def _per_label(condition: str, columns=LABELS, name: str = "label") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, count(*) FILTER ({condition.format(c)}) AS n FROM comments" for c in columns
    )


@query("category_distribution", C + _per_label("{} = 1", LABELS + IDENTITIES, "category"))
def _(spark, d):
    return profile.category_distribution(fx.comments(spark, d), LABELS + IDENTITIES)


@query("value_counts", C + "SELECT label_count, count(*) AS n FROM comments GROUP BY label_count")
def _(spark, d):
    return profile.value_counts(fx.comments(spark, d), "label_count")


@query(
    "value_counts_by_frequency",
    C + "SELECT category_count, count(*) AS n FROM comments WHERE label_count > 0 GROUP BY category_count",
)
def _(spark, d):
    return profile.value_counts(fx.comments(spark, d).where("label_count > 0"), "category_count", True)


@query(
    "co_occurrence",
    C + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(sum({a} * {b}) AS BIGINT) AS n FROM comments" for a in LABELS for b in LABELS
    ),
)
def _(spark, d):
    return profile.co_occurrence(fx.comments(spark, d))


@query("pair_with_primary", C + _per_label("{} = 1 AND toxic = 1 AND label_count = 2"))
def _(spark, d):
    return profile.pair_with_primary(fx.comments(spark, d))


@query("exclusive_count", C + _per_label("{} = 1 AND label_count = 1"))
def _(spark, d):
    return profile.exclusive_count(fx.comments(spark, d))


@query("describe_length", C + _describe_sql("comment_length", "comments", "toxic"))
def _(spark, d):
    return _rounded(profile.describe(fx.comments(spark, d), ["comment_length"], ["toxic"]), *_STATS)


@query(
    "describe_corpus",
    C + " UNION ALL ".join(_describe_sql(c, "comments") for c in ["comment_length", "target", *LABELS]),
)
def _(spark, d):
    return _rounded(profile.describe(fx.comments(spark, d), ["comment_length", "target", *LABELS]), *_STATS)


@query(
    "label_correlation",
    C + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM comments" for a in LABELS for b in LABELS
    ),
)
def _(spark, d):
    return _rounded(profile.label_correlation(fx.comments(spark, d)), "r")


@query("nunique_text", "SELECT count(DISTINCT text) AS n_unique FROM documents")
def _(spark, d):
    return profile.nunique(fx.documents(spark, d), "text")


@query(
    "label_by_identity",
    C + " UNION ALL ".join(
        f"SELECT '{i}' AS identity, "
        + ", ".join(f"count(*) FILTER ({c} = 1) AS {c}" for c in LABELS)
        + f" FROM comments WHERE {i} = 1"
        for i in IDENTITIES
    ),
)
def _(spark, d):
    return profile.label_by_identity(fx.comments(spark, d))


@query(
    "size_by_label",
    C + " UNION ALL ".join(
        f"SELECT label_count, '{c}' AS label, count(*) AS n FROM comments WHERE {c} = 1 GROUP BY label_count"
        for c in LABELS
    ),
)
def _(spark, d):
    return profile.cooccurrence_size_by_label(fx.comments(spark, d))


@query(
    "length_histogram",
    C + ", ends AS (SELECT min(comment_length) AS lo, (max(comment_length) - min(comment_length)) / 30.0::DOUBLE AS w "
    "FROM comments), filled AS (SELECT CAST(least(floor((comment_length - lo) / w), 29) AS INT) AS bin, count(*) AS n "
    "FROM comments, ends GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * w, 6) AS bin_start, "
    "round(lo + (b.bin + 1) * w, 6) AS bin_end, coalesce(n, 0) AS n FROM range(30) b(bin) CROSS JOIN ends "
    "LEFT JOIN filled USING (bin)",
)
def _(spark, d):
    return _rounded(profile.histogram(fx.comments(spark, d), "comment_length", 30), "bin_start", "bin_end")


@query(
    "length_density",
    C + ", v AS (SELECT comment_length::DOUBLE AS v, count(*) AS r FROM comments GROUP BY 1), st AS (SELECT count(*) "
    "AS n, stddev_samp(comment_length) * count(*) ** -0.2 AS h, min(comment_length) AS lo, (max(comment_length) - "
    "min(comment_length)) / 199.0::DOUBLE AS step FROM comments), g AS (SELECT CAST(i AS INT) AS grid_point, "
    "lo + i * step AS x FROM range(200) t(i), st) SELECT grid_point, round(x, 6) AS x, round(sum(r * exp(-0.5 * "
    "((x - v) / h) ** 2)) / (n * h * sqrt(2 * pi())) * 1000, 6) AS density FROM g, v, st GROUP BY grid_point, x, n, h",
)
def _(spark, d):
    curve = profile.density(fx.comments(spark, d), "comment_length")
    return _rounded(curve.withColumn("density", F.col("density") * 1000), "x", "density")


@query(
    "split_stats",
    C + f"SELECT 'Full' AS split, count(*) AS total, round(avg(CASE WHEN {ANY_LABEL} > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) "
    "AS toxic_ratio FROM comments",
)
def _(spark, d):
    return _rounded(profile.split_stats(fx.comments(spark, d), "Full"), "toxic_ratio")


@query(
    "num_retained",
    C + ", k AS (SELECT *, CASE WHEN label_count > 3 OR severe_toxic = 1 OR threat = 1 THEN 1 ELSE 0 END AS keep "
    "FROM comments) SELECT count(*) FILTER (keep = 1) AS kept, count(*) FILTER (keep = 1 AND category_count > 0) "
    "AS kept_with_identity FROM k",
)
def _(spark, d):
    return profile.num_retained(project.seed_keep(fx.comments(spark, d)))


@query(
    "class_weights",
    C + " UNION ALL ".join(
        f"SELECT '{c}' AS label, CAST(sum({c}) AS BIGINT) AS positive, CAST(count(*) - sum({c}) AS BIGINT) AS negative, "
        f"round(100.0::DOUBLE * sum({c}) / count(*), 6) AS positive_pct, "
        f"round(100.0::DOUBLE * (count(*) - sum({c})) / count(*), 6) AS negative_pct, "
        f"round((count(*) - sum({c})) / (sum({c}) + 1e-5::DOUBLE), 6) AS weight FROM comments"
        for c in LABELS
    ),
)
def _(spark, d):
    return _rounded(profile.class_weights(fx.comments(spark, d)), "positive_pct", "negative_pct", "weight")


# ----------------------------------------------------------------- sampling ---
@query("sample_n", C + f"SELECT id, toxic FROM comments ORDER BY {_key()} LIMIT 100")
def _(spark, d):
    return sample.sample_n(fx.comments(spark, d), 100).select("id", "toxic")


@query("shuffle_positions", C + f"SELECT id, row_number() OVER (ORDER BY {_key()}) - 1 AS position FROM comments")
def _(spark, d):
    return sample.shuffle_positions(fx.comments(spark, d).select("id"))


@query("peek", C + f"SELECT id, comment_text FROM comments ORDER BY {_key('id', 0)} LIMIT 10")
def _(spark, d):
    return sample.peek(fx.comments(spark, d)).select("id", "comment_text")


def _identity_sql(n: int, where: str = "TRUE") -> str:
    return " UNION ".join(
        f"(SELECT id FROM comments WHERE {c} = 1 AND comment_length <= 400 AND {where} "
        f"ORDER BY category_count, id LIMIT {n // len(IDENTITIES)})"
        for c in IDENTITIES
    )


@query("identity_topk", C + f"SELECT id FROM ({_identity_sql(90)})")
def _(spark, d):
    return sample.select_by_identity(freeze(fx.comments(spark, d).drop("comment_text")), n=90).select("id")


@query(
    "quota_rule",
    C + f", picked AS (SELECT id FROM comments WHERE insult = 1 AND label_count = 2 AND category_count <= 1 "
    f"ORDER BY {_key()} LIMIT 40) SELECT id, CASE WHEN id IN (SELECT id FROM picked) THEN 1 ELSE 0 END AS keep "
    "FROM comments",
)
def _(spark, d):
    rows = fx.comments(spark, d).withColumn("keep", F.lit(0))
    return sample.add_category_samples(rows, sample.QuotaRule("insult", 40, 1, 2)).select("id", "keep")


SCALED_RULES = [r._replace(n=max(2, r.n // 200)) for r in sample.QUOTA_PROGRAMME]


def _quota_sql(rules) -> str:
    parts = [
        "k0 AS (SELECT id, label_count, category_count, CASE WHEN label_count > 3 OR severe_toxic = 1 OR threat = 1 "
        f"THEN 1 ELSE 0 END AS keep, {', '.join(dict.fromkeys(r.category for r in rules))} FROM comments "
        "WHERE label_count > 0)"
    ]
    for i, r in enumerate(rules):
        pick = (
            f"SELECT id FROM k{i} WHERE {r.category} = 1 AND keep = 0 AND label_count = {r.label_count} AND "
            f"category_count <= {r.max_identities} ORDER BY {_key('id', f'{SEED}-{i}')} LIMIT {r.n}"
        )
        parts.append(
            f"k{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN keep = 1 OR id IN ({pick}) THEN 1 ELSE 0 END "
            f"AS keep) FROM k{i})"
        )
    return ", " + ", ".join(parts)


QUOTA_SQL = _quota_sql(SCALED_RULES)
LAST = f"k{len(SCALED_RULES)}"


@query("quota_rules", C + QUOTA_SQL + f" SELECT id, keep FROM {LAST}")
def _(spark, d):
    rows = project.seed_keep(freeze(fx.comments(spark, d).drop("comment_text").where("label_count > 0")))
    return sample.apply_quota_rules(rows, SCALED_RULES).select("id", "keep")


PICKS = [(50, "insult", 1), (100, "obscene", 1), (20, "threat", 1), (200, "toxic", 0), (1500, "toxic", 0)]


@query(
    "select_n",
    C + "SELECT id, CASE WHEN "
    + " OR ".join(
        f"id IN (SELECT id FROM comments WHERE {c} = {v} ORDER BY id LIMIT {n})" for n, c, v in PICKS
    )
    + " THEN 1 ELSE 0 END AS keep FROM comments",
)
def _(spark, d):
    return sample.select_n(fx.comments(spark, d), PICKS, ["id"]).select("id", "keep")


def _split_sql(source: str, size: str) -> str:
    """Quota arithmetic of the stratified split, truncating step by step."""
    return (
        f", st AS (SELECT *, {STRATUM_SQL} AS stratum FROM {source}), "
        "ct AS (SELECT count(*) AS n, count(*) FILTER (stratum LIKE 'toxic%') AS tox, "
        "count(*) FILTER (stratum LIKE 'clean%') AS cln, count(*) FILTER (stratum = 'toxic_identity') AS ti, "
        "count(*) FILTER (stratum = 'clean_identity') AS ci FROM st), "
        f"q1 AS (SELECT *, CAST(trunc(n * {size}::DOUBLE) AS BIGINT) AS w FROM ct), "
        "q2 AS (SELECT *, CAST(trunc(w * (tox / n::DOUBLE)) AS BIGINT) AS tn FROM q1), "
        "q3 AS (SELECT *, CAST(trunc(tn * (ti / tox::DOUBLE)) AS BIGINT) AS tin, "
        "CAST(trunc((w - tn) * (ci / cln::DOUBLE)) AS BIGINT) AS cin FROM q2), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_key()}) AS r FROM st), "
        "fl AS (SELECT rk.*, CASE WHEN r <= CASE stratum WHEN 'toxic_identity' THEN tin WHEN 'toxic_plain' "
        "THEN tn - tin WHEN 'clean_identity' THEN cin ELSE w - tn - cin END THEN 1 ELSE 0 END AS is_test FROM rk, q3)"
    )


@query("split_quota", C + _split_sql("comments", "0.2") + " SELECT id, is_test FROM fl")
def _(spark, d):
    return sample.flag_split(fx.comments(spark, d)).select("id", "is_test")


_CLASS_SIZES = "n AS (SELECT least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0)) AS n FROM comments)"


def _class_draw(side: int, limit: str = "(SELECT n FROM n)", extra: str = "") -> str:
    return (
        f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_key()}) AS r FROM comments WHERE toxic = {side} "
        f"{extra}) WHERE r <= {limit}"
    )


@query(
    "balance_down",
    C + f", {_CLASS_SIZES} SELECT id, toxic FROM comments WHERE id IN ({_class_draw(1)}) OR id IN ({_class_draw(0)})",
)
def _(spark, d):
    return sample.balance_binary(fx.comments(spark, d)).select("id", "toxic")


@query(
    "balance_position",
    f"SELECT id, toxic, row_number() OVER (ORDER BY {_key()}, id) - 1 AS position FROM ({ORACLES[list(ORACLES)[-1]]})",
)
def _(spark, d):
    """Balanced rows with their place in the final seeded order."""
    return sample.shuffle_positions(sample.balance_binary(fx.comments(spark, d)).select("id", "toxic"))


def _identity_window_sql(per_category: str, where: str) -> str:
    return " UNION ".join(
        f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY category_count, id) AS r FROM comments "
        f"WHERE {c} = 1 AND comment_length <= 400 AND {where}) WHERE r <= {per_category}"
        for c in IDENTITIES
    )


_BALANCE_IDENTITY = (
    f", {_CLASS_SIZES}, w AS (SELECT n, CAST(trunc(n * 0.5::DOUBLE) AS BIGINT) AS wi FROM n), picked AS ("
    + _identity_window_sql(f"(SELECT wi // {len(IDENTITIES)} FROM w)", "toxic = 0")
    + "), chosen AS (SELECT id FROM picked UNION ALL "
    + _class_draw(0, "(SELECT n - wi FROM w)", "AND id NOT IN (SELECT id FROM picked)")
    + f" UNION ALL {_class_draw(1)})"
)


@query(
    "balance_identity", C + _BALANCE_IDENTITY + " SELECT id, toxic FROM comments WHERE id IN (SELECT id FROM chosen)"
)
def _(spark, d):
    rows = freeze(fx.comments(spark, d).drop("comment_text"))
    balanced = sample.balance_binary(
        rows, identity_categories=IDENTITIES, identity_fraction=0.5
    )
    return balanced.select("id", "toxic")


def _bootstrap_sql(name: str, condition: str) -> str:
    pick = f"('0x' || substr(md5(concat_ws(':', '{SEED}', '{name}', s.slot)), 1, 15))::BIGINT"
    return (
        f"SELECT r.id, r.toxic, s.slot FROM (SELECT unnest(range((SELECT n FROM m))) AS slot) s JOIN (SELECT id, toxic, "
        f"row_number() OVER (ORDER BY {_key()}) AS r, count(*) OVER () AS size FROM comments WHERE {condition}) r "
        f"ON r.r = {pick} % r.size + 1"
    )


@query(
    "balance_up",
    C + ", m AS (SELECT greatest(count(*) FILTER (toxic > 0), count(*) FILTER (toxic = 0)) AS n FROM comments) "
    + _bootstrap_sql("pos", "toxic > 0") + " UNION ALL " + _bootstrap_sql("neg", "toxic = 0"),
)
def _(spark, d):
    return sample.balance_binary(fx.comments(spark, d).select("id", "toxic"), method="upsample")


# -------------------------------------------------------- batch translation ---
_BATCHED = (
    "b AS (SELECT doc_id AS id, text AS comment_text, row_number() OVER (ORDER BY doc_id) - 1 AS position, "
    "CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch_id FROM documents)"
)


def _batched(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"))
    return batch.assign_batches(rows, ["id"])


@query("assign_batches", _with(_BATCHED) + "SELECT id, position, batch_id FROM b")
def _(spark, d):
    return _batched(spark, d).select("id", "position", "batch_id")


@query(
    "first_batches",
    _with(_BATCHED) + "SELECT id, batch_id FROM b WHERE batch_id < 10",
)
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"))
    return batch.assign_batches(rows, ["id"], 20, 10).select("id", "batch_id")


@query(
    "batch_requests",
    _with(_BATCHED)
    + f"SELECT batch_id, count(*) AS n_rows, concat({_quoted(fx.PROMPT)}, string_agg(concat('id: ', id, "
    "', text: ''', comment_text, ''''), chr(10) ORDER BY position)) AS request FROM b GROUP BY batch_id",
)
def _(spark, d):
    return batch.format_requests(_batched(spark, d), fx.PROMPT)


def _responses(batched: DataFrame, malformed: bool = False) -> DataFrame:
    """A stand-in service: one JSON list per batch, without the rows of German documents."""
    item = F.struct(F.col("id").cast("string").alias("id"), F.col("comment_text").alias("translated"))
    answered = batched.where("lang <> 'de'")
    if malformed:
        line = F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit(', translated: "'), F.col("comment_text"), F.lit('"'))
        lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
        body = F.array_join(F.transform(lines, lambda x: x["line"]), "},\n{")
        response = F.concat(F.lit("[{"), body, F.lit("}]"))
    else:
        items = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))
        response = F.concat(F.lit("```json\n"), F.to_json(F.transform(items, lambda x: x["item"])), F.lit("\n```"))
    return answered.groupBy("batch_id").agg(response.alias("response"))


def _batched_docs(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment_text"), "lang")
    return batch.assign_batches(rows, ["id"])


_BATCHED_DOCS = _BATCHED.replace("text AS comment_text", "text AS comment_text, lang")
_PARSED = (
    "parsed AS (SELECT batch_id, CAST(id AS VARCHAR) AS id, trim(regexp_replace(replace(comment_text, '\"', ''''), "
    "'\\s+', ' ', 'g')) AS translated FROM b WHERE lang <> 'de')"
)


@query("parse_responses", _with(_BATCHED_DOCS, _PARSED) + "SELECT batch_id, id, translated FROM parsed")
def _(spark, d):
    return batch.parse_responses(_responses(_batched_docs(spark, d)))


_FALLBACK_PARSED = _PARSED.replace(
    "comment_text, '\"'", """regexp_extract(comment_text || '"}', '(?s)^(.+?)["'']?\\s*[,}\\]]', 1), '\"'"""
)


@query("parse_fallback", _with(_BATCHED_DOCS, _FALLBACK_PARSED) + "SELECT batch_id, id, translated FROM parsed")
def _(spark, d):
    """Lists that are no JSON; quotes, commas, braces and line breaks of the texts stay, and a text ends where the pattern ends it."""
    return batch.parse_responses(_responses(_batched_docs(spark, d), malformed=True))


@query(
    "missing_ids",
    _with(_BATCHED_DOCS) + "SELECT batch_id, CAST(id AS VARCHAR) AS id FROM b WHERE lang = 'de'",
)
def _(spark, d):
    batched = _batched_docs(spark, d)
    requested = batched.select("batch_id", F.col("id").cast("string").alias("id"))
    return setops.missing_ids(requested, batch.parse_responses(_responses(batched)))


@query(
    "translation_report",
    _with(_BATCHED_DOCS)
    + "SELECT batch_id, count(*) AS requested, count(*) FILTER (lang <> 'de') AS parsed, count(*) FILTER (lang = 'de') "
    "AS missing, CASE WHEN count(*) FILTER (lang <> 'de') = 0 THEN 1 ELSE 0 END AS none_parsed FROM b GROUP BY batch_id",
)
def _(spark, d):
    batched = _batched_docs(spark, d)
    return batch.translation_report(batched, batch.parse_responses(_responses(batched)))


def upper_service(request: str) -> str:
    """A stand-in translator: answers every requested line in lower case."""
    lines = request.split(fx.PROMPT, 1)[1].split("\nid: ")
    answer = []
    for line in lines:
        row_id, body = line.removeprefix("id: ").split(", text: '", 1)
        answer.append({"id": row_id, "translated": body.removesuffix("'").lower()})
    return json.dumps(answer, ensure_ascii=False)


@query(
    "apply_batches",
    _with(_BATCHED)
    + """SELECT batch_id, count(*) AS n_rows, '[' || string_agg('{"id": "' || id || '", "translated": ' """
    + "|| CAST(to_json(lower(comment_text)) AS VARCHAR) || '}', ', ' ORDER BY position) || ']' AS response, "
    "CAST(NULL AS VARCHAR) AS error FROM b GROUP BY batch_id",
)
def _(spark, d):
    return batch.apply_batches(batch.format_requests(_batched(spark, d), fx.PROMPT), upper_service).drop("request")


# ------------------------------------------------------- scores and verdicts ---
def _model_input(spark, d, limit=None):
    rows = score.build_model_input(fx.comments(spark, d), text="comment_text", max_length=limit)
    labels = F.array_join(F.transform("labels", lambda x: x.cast("int").cast("string")), ",")
    tokens = F.array_join("tokens", " ")
    return rows.select("id", F.size("tokens").cast("long").alias("n_tokens"), tokens.alias("tokens"), labels.alias("labels"))


_MODEL_INPUT = C + """
SELECT id, len(words) AS n_tokens, array_to_string(words, ' ') AS tokens, labels FROM (
  SELECT id, regexp_extract_all(comment_text, '\\S+'){cut} AS words, array_to_string([{labels}], ',') AS labels FROM comments)"""


@query("model_input", _MODEL_INPUT.replace("{cut}", "").replace("{labels}", ", ".join(LABELS)))
def _(spark, d):
    return _model_input(spark, d)


@query("model_input_limited", _MODEL_INPUT.replace("{cut}", "[1:128]").replace("{labels}", ", ".join(LABELS)))
def _(spark, d):
    return _model_input(spark, d, 128)


@query(
    "probabilities",
    S + "SELECT id, " + ", ".join(f"round(1 / (1 + exp(-z_{c})), 4) AS p_{c}" for c in LABELS) + " FROM scores",
)
def _(spark, d):
    return score.logits_to_probs(fx.scores(spark, d)).select("id", *[f"p_{c}" for c in LABELS])


def _labels_sql(limits) -> str:
    return ", ".join(
        f"CASE WHEN round(1 / (1 + exp(-z_{c})), 4) >= {limits[c]} THEN 1 ELSE 0 END AS b_{c}" for c in LABELS
    )


@query("thresholded_labels", S + f"SELECT id, {_labels_sql(DEFAULT_THRESHOLDS)} FROM scores")
def _(spark, d):
    rows = score.apply_thresholds(score.logits_to_probs(fx.scores(spark, d)))
    return rows.select("id", *[f"b_{c}" for c in LABELS])


@query(
    "verdicts",
    S + f", b AS (SELECT id, {_labels_sql({c: 0.5 for c in LABELS})} FROM scores), n AS (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN b_{c} = 1 THEN '  🔸 {c.replace('_', ' ').upper()}' END" for c in LABELS[1:])
    + f"], lambda x: x IS NOT NULL) AS names FROM b) SELECT id, CASE WHEN {' + '.join('b_' + c for c in LABELS)} = 0 THEN "
    f"'{score.VERDICT_CLEAN}' ELSE '{score.VERDICT_TOXIC}' || CASE WHEN len(names) > 0 THEN "
    "' It belongs to the following toxicity categories:' || chr(10) || array_to_string(names, chr(10)) ELSE '' END END "
    "AS verdict FROM n",
)
def _(spark, d):
    rows = score.apply_thresholds(score.logits_to_probs(fx.scores(spark, d)), 0.5)
    return score.verdict(rows).select("id", "verdict")


@query(
    "label_names",
    C + "SELECT id, uk, en FROM comments JOIN (VALUES "
    + ", ".join(f"('{c}', '{uk}', '{c.replace('_', ' ').title()}')" for c, uk in LABEL_NAMES_UK.items())
    + ") n(label, uk, en) ON CASE label "
    + " ".join(f"WHEN '{c}' THEN {c} = 1" for c in LABELS)
    + " END",
)
def _(spark, d):
    hit = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in LABELS]))
    rows = fx.comments(spark, d).select("id", F.explode(hit).alias("label"))
    label = F.col("label")
    return rows.select("id", score.label_name(label).alias("uk"), score.label_name(label, "en").alias("en"))


@query(
    "bce_loss",
    L + ", w AS (SELECT label, (count(*) - sum(y)) / (sum(y) + 1e-5::DOUBLE) AS w FROM long GROUP BY label) "
    "SELECT round(avg(w * y * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) + (1 - y) * (ln(1 + exp(-abs(z))) + "
    "greatest(z, 0))), 6) AS loss FROM long JOIN w USING (label)",
)
def _(spark, d):
    rows = fx.scores(spark, d)
    truth = rows.select(*[F.col(f"y_{c}").alias(c) for c in LABELS])
    weights = {r["label"]: r["weight"] for r in profile.class_weights(truth).collect()}
    return _rounded(train.bce_loss(rows, weights=weights), "loss")


def word_model():
    """A tiny deterministic model: logits from the shares of a few letter pairs."""
    import numpy as np

    pairs = ["th", "en", "ou", "ai", "er", "nd"]

    def model(texts):
        counts = np.array([[t.count(p) for p in pairs] for t in texts], dtype=float).reshape(-1, len(pairs))
        lengths = np.array([max(len(t), 1) for t in texts], dtype=float)
        return counts / lengths[:, None] * 40 - 1

    return model


def _scored_sql() -> str:
    """Cleaned text, letter-pair logits, four-digit probabilities, default thresholds and verdict."""
    plain = _CHAIN_SQL.replace(fx.SQL_DECORATED, "decorated AS (SELECT doc_id, text AS t FROM documents)")
    pairs = zip(LABELS, ["th", "en", "ou", "ai", "er", "nd"])
    prob = ", ".join(
        f"round(1 / (1 + exp(-((length(c) - length(replace(c, '{pair}', ''))) / 2 / greatest(length(c), 1)::DOUBLE * 40 - 1))), 4) "
        f"AS p_{label}"
        for label, pair in pairs
    )
    bits = ", ".join(f"CASE WHEN p_{c} >= {DEFAULT_THRESHOLDS[c]} THEN 1 ELSE 0 END AS b_{c}" for c in LABELS)
    names = ", ".join(f"CASE WHEN b_{c} = 1 THEN '  🔸 {c.replace('_', ' ').upper()}' END" for c in LABELS[1:])
    return (
        f"WITH cleaned AS ({plain}), p AS (SELECT doc_id AS id, {prob} FROM (SELECT doc_id, cleaned AS c FROM cleaned)), "
        f"b AS (SELECT *, {bits} FROM p), n AS (SELECT *, list_filter([{names}], lambda x: x IS NOT NULL) AS names FROM b) "
        f"SELECT id, {', '.join('p_' + c for c in LABELS)}, CASE WHEN {' + '.join('b_' + c for c in LABELS)} = 0 THEN "
        f"'{score.VERDICT_CLEAN}' ELSE '{score.VERDICT_TOXIC}' || CASE WHEN len(names) > 0 THEN "
        "' It belongs to the following toxicity categories:' || chr(10) || array_to_string(names, chr(10)) ELSE '' END END "
        "AS verdict FROM n"
    )


@query("score_documents", _scored_sql())
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    scored = score.apply_thresholds(score.logits_to_probs(score.score(rows, word_model)))
    return score.verdict(scored).select("id", *[f"p_{c}" for c in LABELS], "verdict")


@query("fit_multilabel")
def _(spark, d):
    rows = fx.comments(spark, d).withColumnRenamed("comment_text", "comment")
    model = train.fit_multilabel(rows)
    scored = score.logits_to_probs(model.logits(rows), digits=None)
    truth = scored.withColumns({f"y_{c}": F.col(c) for c in LABELS})
    return evaluate.evaluate(truth)


@query("stream_weak_labels", _with(_WEAK.format(id="doc_id", rules=_rules_sql("lower(text)", fx.LEXICON), source="documents"))
       + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) FILTER ({c} = 1) AS n FROM labelled" for c in LABELS))
def _(spark, d):
    schema = fx.documents(spark, d).schema
    arriving = scoring.read_stream(spark, f"{d}/documents*.parquet", schema)
    rows = arriving.select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    labelled = weak.weak_label(rows, fx.LEXICON)
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    scoring.run_available(labelled, out, state)
    return profile.category_distribution(spark.read.parquet(out))


@query("stream_scores", f"SELECT id, verdict FROM ({_scored_sql()})")
def _(spark, d):
    schema = fx.documents(spark, d).schema
    arriving = scoring.read_stream(spark, f"{d}/documents*.parquet", schema)
    rows = arriving.select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    scoring.run_available(scoring.score_stream(rows, word_model).select("id", "verdict"), out, state)
    return spark.read.parquet(out)


# --------------------------------------------------------------- evaluation ---
_COUNTS = (
    "cm AS (SELECT label, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, "
    "count(*) FILTER (p < t AND y = 1) AS fn, count(*) FILTER (p < t AND y = 0) AS tn FROM (SELECT *, {} AS t FROM long) "
    "GROUP BY label)"
)
CM = L + ", " + _COUNTS.format("0.5")
TUNED = "CASE label " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in DEFAULT_THRESHOLDS.items()) + " END"
_F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"


@query("confusion", L + ", " + _COUNTS.format(TUNED) + " SELECT label, tp, fp, fn, tn FROM cm")
def _(spark, d):
    return evaluate.confusion(fx.scores(spark, d), thresholds=DEFAULT_THRESHOLDS)


@query(
    "macro_metrics",
    CM + f" SELECT round(avg({_F1}), 6) AS macro_f1, round(avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)), 6) AS "
    "macro_precision, round(avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)), 6) AS macro_recall FROM cm",
)
def _(spark, d):
    rows = evaluate.macro_metrics(fx.scores(spark, d))
    return _rounded(rows, *rows.columns)


@query(
    "micro_f1",
    CM + " SELECT round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM cm",
)
def _(spark, d):
    return _rounded(evaluate.micro_f1(fx.scores(spark, d)), "micro_f1")


_SUBSET = (
    "SELECT round(avg(CASE WHEN " + " AND ".join(f"(p_{c} >= 0.5) = (y_{c} = 1)" for c in LABELS)
    + " THEN 1.0::DOUBLE ELSE 0 END), 6) FROM scores"
)


@query("subset_hamming", CM + f" SELECT ({_SUBSET}) AS subset_accuracy, round(sum(fp + fn)::DOUBLE / "
       "sum(tp + fp + fn + tn), 6) AS hamming_loss FROM cm")
def _(spark, d):
    rows = evaluate.aggregate_metrics(fx.scores(spark, d)).select("subset_accuracy", "hamming_loss")
    return _rounded(rows, *rows.columns)


@query("per_label_f1", CM + f" SELECT label, round({_F1}, 6) AS f1 FROM cm")
def _(spark, d):
    return _rounded(evaluate.per_label_f1(fx.scores(spark, d)), "f1")


_RANKED = (
    "g AS (SELECT label, p AS s, sum(y) AS p, sum(1 - y) AS n FROM long GROUP BY label, s), "
    "c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY label ORDER BY s DESC)), "
    "auc AS (SELECT label, round(sum(n * ((cp - p) + p / 2.0::DOUBLE)) / (sum(p) * sum(n))::DOUBLE, 6) AS roc_auc, "
    "round(sum(p * cp::DOUBLE / (cp + cn)) / sum(p), 6) AS pr_auc FROM c GROUP BY label)"
)


@query("roc_auc", L + ", " + _RANKED + " SELECT label, roc_auc FROM auc")
def _(spark, d):
    return _rounded(evaluate.roc_auc(fx.scores(spark, d)), "roc_auc")


@query("average_precision", L + ", " + _RANKED + " SELECT label, pr_auc FROM auc")
def _(spark, d):
    return _rounded(evaluate.average_precision(fx.scores(spark, d)), "pr_auc")


_SWEEP = (
    "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(evaluate.SWEEP))
    + ") g(step, threshold)), sw AS (SELECT label, step, threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, "
    "count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn "
    "FROM long, grid GROUP BY label, step, threshold)"
)


@query("threshold_sweep", L + f", {_SWEEP} SELECT label, step, round(threshold, 6) AS threshold, round({_F1}, 6) AS f1 FROM sw")
def _(spark, d):
    return _rounded(evaluate.threshold_sweep(fx.scores(spark, d)), "threshold", "f1")


_TUNED = (
    f"best AS (SELECT label, threshold, f1 FROM (SELECT label, threshold, {_F1} AS f1, row_number() OVER (PARTITION BY "
    f"label ORDER BY {_F1} DESC, step) AS r FROM sw) WHERE r = 1), base AS (SELECT label, {_F1} AS f1 FROM cm)"
)


@query(
    "optimize_thresholds",
    CM + f", {_SWEEP}, {_TUNED} SELECT label, round(threshold, 6) AS threshold, round(base.f1, 6) AS f1_at_half, "
    "round(best.f1, 6) AS best_f1, round(best.f1 - base.f1, 6) AS gain FROM best JOIN base USING (label)",
)
def _(spark, d):
    rows = evaluate.optimize_thresholds(fx.scores(spark, d))
    return _rounded(rows, *[c for c in rows.columns if c != "label"])


@query(
    "evaluate_all",
    CM + ", " + _RANKED + f", e AS (SELECT label, {_F1} AS f1, roc_auc, pr_auc FROM cm JOIN auc USING (label)) SELECT "
    f"(SELECT round(avg(f1), 6) FROM e) AS macro_f1, "
    "(SELECT round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) FROM cm) AS micro_f1, "
    "(SELECT round(avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)), 6) FROM cm) AS macro_precision, "
    "(SELECT round(avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)), 6) FROM cm) AS macro_recall, "
    f"({_SUBSET}) AS subset_accuracy, "
    "(SELECT round(sum(fp + fn)::DOUBLE / sum(tp + fp + fn + tn), 6) FROM cm) AS hamming_loss, "
    + ", ".join(
        f"(SELECT round({m}, 6) FROM e WHERE label = '{c}') AS {c}_{m}" for c in LABELS for m in ("f1", "roc_auc", "pr_auc")
    ),
)
def _(spark, d):
    rows = evaluate.evaluate(fx.scores(spark, d))
    return _rounded(rows, *rows.columns)


# ------------------------------------------------------------ composite jobs ---
_LABEL_SUM = " + ".join(LABELS)


@query(
    "job_consolidate_toxic",
    C + f"SELECT id, comment_text, {LABEL_LIST}, label_count, comment_length FROM comments "
    "UNION ALL SELECT * FROM (SELECT item_id AS id, b.text AS comment_text, toxic, severe_toxic, obscene, threat, insult, "
    "identity_hate, label_count, CAST(len(regexp_extract_all(b.text, '\\S+')) AS INT) AS comment_length "
    "FROM benchmark b JOIN comments c ON b.item_id = c.id WHERE c.severe_toxic = 0)",
)
def _(spark, d):
    rows = fx.comments(spark, d)
    labels = rows.select("id", *LABELS)
    hidden = {c: F.when(F.col("severe_toxic") == 1, -1).otherwise(F.col(c)) for c in LABELS}
    texts = fx.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("comment_text"))
    given = rows.select("id", "comment_text", *LABELS)
    return jobs.consolidate_toxic(given, texts, labels.select("id", *[e.alias(c) for c, e in hidden.items()]))


def _fractional(spark, d) -> DataFrame:
    """Bias-corpus shape: 0/1 labels as fractions around the threshold."""
    rows = fx.comments(spark, d)
    soft = lambda c: F.when(F.col(c) == 1, 0.5 + (F.col("id") % 5) / 10).otherwise((F.col("id") % 5) / 10)
    names = {"target": "toxic", "severe_toxicity": "severe_toxic", "identity_attack": "identity_hate"}
    labels = [soft(names.get(c, c)).alias(c) for c in ("target", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")]
    return rows.select("id", "comment_text", *labels, *[soft(c).alias(c) for c in IDENTITIES])


_BIAS_SUM = "toxic + obscene + threat + insult + identity_hate"


@query(
    "job_consolidate_bias",
    C + f", p AS (SELECT id FROM comments WHERE label_count = 0 AND category_count = 0 ORDER BY {_key()} LIMIT 100) "
    "SELECT id, comment_text, toxic AS toxicity, severe_toxic AS severe_toxicity, obscene, threat, insult, "
    f"identity_hate AS identity_attack, {', '.join(IDENTITIES)}, CASE WHEN label_count > 0 THEN {_BIAS_SUM} ELSE -1 END AS "
    "label_count, CASE WHEN label_count > 0 OR category_count > 0 THEN category_count ELSE -1 END AS category_count, "
    "comment_length FROM comments WHERE label_count > 0 OR category_count > 0 OR id IN (SELECT id FROM p)",
)
def _(spark, d):
    rows = jobs.consolidate_bias(_fractional(spark, d), plain_n=100, strict=False)
    return rows.na.fill(-1, ["label_count", "category_count"])


@query(
    "job_integrate",
    C + ", a AS (SELECT 0 AS src, id, comment_text, " + LABEL_LIST + ", " + ", ".join(f"0 AS {c}" for c in IDENTITIES)
    + " FROM comments WHERE target >= 0.5 UNION ALL SELECT 1, id, comment_text, " + LABEL_LIST + ", "
    + ", ".join(IDENTITIES) + " FROM comments), r AS (SELECT *, row_number() OVER (PARTITION BY comment_text ORDER BY "
    f"src, id) AS r FROM a) SELECT id, comment_text, {LABEL_LIST}, {', '.join(IDENTITIES)}, {_LABEL_SUM} AS label_count, "
    f"{' + '.join(IDENTITIES)} AS category_count FROM r WHERE r = 1",
)
def _(spark, d):
    rows = fx.comments(spark, d)
    toxic = rows.where("target >= 0.5").select("id", "comment_text", *LABELS)
    names = {"toxic": "toxicity", "severe_toxic": "severe_toxicity", "identity_hate": "identity_attack"}
    bias = project.align_names(rows.select("id", "comment_text", *LABELS, *IDENTITIES), names)
    out = jobs.integrate(toxic, bias)
    return out.select("id", "comment_text", *LABELS, *IDENTITIES, "label_count", "category_count")


_CORPUS_SQL = (
    C + QUOTA_SQL + f", corpus AS (SELECT id FROM {LAST} WHERE keep = 1 UNION ALL (SELECT id FROM comments WHERE "
    "label_count = 0 AND category_count = 0 AND comment_length <= 400 AND NOT contains(lower(comment_text), 'wikipedia') "
    f"ORDER BY {_key()} LIMIT 100) UNION ALL (SELECT id FROM ("
    + _identity_sql(45, "label_count = 0 AND category_count > 0")
    + "))), cc AS (SELECT * FROM comments WHERE id IN (SELECT id FROM corpus))"
)


def _corpus(spark, d):
    """Sampling reads its corpus dozens of times, so it starts from a stored stage, not from a view."""
    return jobs.sample_corpus(freeze(fx.comments(spark, d)), 100, 45, SCALED_RULES, strict=False)


@query("job_sample_corpus", _CORPUS_SQL + " SELECT id, label_count, category_count FROM cc")
def _(spark, d):
    return _corpus(spark, d).select("id", "label_count", "category_count")


@query("job_split", _CORPUS_SQL + _split_sql("cc", "0.1") + " SELECT id, is_test FROM fl")
def _(spark, d):
    return jobs.flag_corpus_split(_corpus(spark, d)).select("id", "is_test")


@query(
    "job_split_stats",
    _CORPUS_SQL + _split_sql("cc", "0.1") + ", parts AS (SELECT 'Full' AS split, * FROM fl UNION ALL SELECT CASE is_test "
    f"WHEN 1 THEN 'Test' ELSE 'Train' END, * FROM fl) SELECT split, count(*) AS total, round(avg(CASE WHEN {ANY_LABEL} > 0 "
    "THEN 1.0::DOUBLE ELSE 0 END), 6) AS toxic_ratio FROM parts GROUP BY split",
)
def _(spark, d):
    _train, _test, stats = jobs.split_corpus(_corpus(spark, d))
    return _rounded(stats, "toxic_ratio")


@query("job_prepare_translation")
def _(spark, d):
    return jobs.prepare_for_translation(fx.comments(spark, d)).select("id", "comment_text", *LABELS)


@query(
    "job_prepare_without_chunks",
    C + ", " + _translation_sql("comments", "id", "coalesce(comment_text, '')")
    + f" SELECT id, cleaned AS comment_text, {', '.join(LABELS)} FROM prepared JOIN comments ON id = doc_id",
)
def _(spark, d):
    rows = jobs.prepare_for_translation(fx.comments(spark, d), remove_repeated_chunks=False)
    return rows.select("id", "comment_text", *LABELS)


@query(
    "job_translate_new",
    _with(fx.SQL_TRANSLATIONS)
    + "SELECT CAST(id AS VARCHAR) AS id, translated FROM translations UNION ALL SELECT CAST(doc_id AS VARCHAR), "
    "trim(regexp_replace(replace(lower(text), '\"', ''''), '\\s+', ' ', 'g')) FROM documents "
    "WHERE doc_id NOT IN (SELECT id FROM translations)",
)
def _(spark, d):
    source = fx.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment_text"), F.col("doc_id").alias("place")
    )
    existing = fx.translations(spark, d).select(F.col("id").cast("string").alias("id"), "translated")
    merged, _report = jobs.translate_new(source, existing, upper_service, fx.PROMPT, order_by=["place"])
    return merged


_FINAL = (
    ", tr AS (SELECT id, translated FROM (SELECT id, translated, row_number() OVER (PARTITION BY translated ORDER BY id) "
    "AS r FROM translations) WHERE r = 1), fin AS (SELECT c.*, t.translated FROM tr t JOIN base c ON t.id = c.id)"
)
@query(
    "job_finalize",
    _with(fx.SQL_TRANSLATIONS, fx.SQL_COMMENTS.replace("comments AS", "base AS", 1))
    + _FINAL
    + f" SELECT id, {_scrub_sql('translated')} AS translated, {_scrub_sql('comment_text')} AS comment_text, "
    "toxic FROM fin",
)
def _(spark, d):
    rows = jobs.finalize_translated(fx.translations(spark, d), fx.comments(spark, d))
    return rows.select("id", "translated", "comment_text", "toxic")


@query(
    "job_finalize_balanced",
    _with(fx.SQL_TRANSLATIONS, fx.SQL_COMMENTS.replace("comments AS", "base AS", 1))
    + _FINAL
    + ", comments AS (SELECT * FROM fin)"
    + _BALANCE_IDENTITY
    + " SELECT id, toxic FROM comments WHERE id IN (SELECT id FROM chosen)",
)
def _(spark, d):
    _rows, balanced = jobs.balance_translated(fx.translations(spark, d), fx.comments(spark, d))
    return balanced.select("id", "toxic")


@query(
    "job_combine_native",
    "WITH a AS (SELECT 0 AS src, item_id AS k, text FROM benchmark UNION ALL SELECT 1, l.doc_id, d.text FROM labels l "
    "JOIN documents d ON l.doc_id = d.doc_id WHERE l.toxic = 1), p AS (SELECT l.doc_id, d.text, l.toxic, row_number() "
    "OVER (ORDER BY l.doc_id) - 1 AS id FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "
    "SELECT 'combined' AS part, row_number() OVER (ORDER BY src, k) - 1 AS id, text AS comment FROM a UNION ALL "
    "SELECT 'clean', id, text FROM p WHERE toxic = 0",
)
def _(spark, d):
    scraped = fx.table(spark, d, "benchmark").select(F.col("text").alias("comment"), F.col("item_id").alias("k"))
    labels = fx.table(spark, d, "labels").select("doc_id", "toxic")
    published = fx.documents(spark, d).join(labels, "doc_id").select(F.col("doc_id").alias("k"), "text", "toxic")
    combined, clean = jobs.combine_native(scraped, published, ["k"])
    return setops.union_same(
        combined.select(F.lit("combined").alias("part"), "id", "comment"),
        clean.select(F.lit("clean").alias("part"), "id", "comment"),
    )


@query(
    "job_label_native",
    _with(WEAK_DOCUMENTS) + " UNION ALL ".join(_describe_sql(c, "labelled") for c in LABELS),
)
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    return _rounded(jobs.label_native(rows, fx.LEXICON)[1], *_STATS)


def _test_set_sql() -> str:
    picks = " OR ".join(
        f"id IN (SELECT id FROM t WHERE {c} = {v} ORDER BY id LIMIT {n})" for n, c, v in jobs.TEST_SET_PICKS
    )
    return (
        _with(fx.SQL_TRANSLATIONS, fx.SQL_COMMENTS)
        + ", t AS (SELECT c.*, translated FROM translations x JOIN comments c ON x.id = c.id), "
        f"pick AS (SELECT id, translated AS comment, {LABEL_LIST} FROM t WHERE {picks}), "
        f"test AS (SELECT -1 - item_id AS id, text AS comment, {', '.join(f'0 AS {c}' for c in LABELS)} FROM benchmark "
        "UNION ALL SELECT * FROM pick) SELECT 'test' AS part, id, toxic FROM test UNION ALL SELECT 'rest', id, toxic FROM t "
        "WHERE id NOT IN (SELECT id FROM test) UNION ALL SELECT 'balanced', id, toxic FROM t WHERE insult = 1 AND "
        "id NOT IN (SELECT id FROM test)"
    )


@query("job_build_test_set", _test_set_sql())
def _(spark, d):
    native = fx.table(spark, d, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), F.col("text").alias("comment"), *[F.lit(0).alias(c) for c in LABELS]
    )
    translated = setops.join_on_id(fx.translations(spark, d), fx.comments(spark, d))
    test, rest, balanced = jobs.build_test_set(native, translated, translated.where("insult = 1"))
    parts = (("test", test), ("rest", rest), ("balanced", balanced))
    return setops.union_same(*[rows.select(F.lit(name).alias("part"), "id", "toxic") for name, rows in parts])


@query(
    "job_normalize",
    _CHAIN_SQL.replace(
        "SELECT doc_id, " + _SPACE_SQL.format("nfc_normalize(cleaned)") + " AS cleaned FROM reduced",
        "SELECT doc_id AS id, " + _SPACE_SQL.format("nfc_normalize(cleaned)") + " AS comment FROM reduced",
    ),
)
def _(spark, d):
    rows = fx.decorated(spark, d).select(F.col("doc_id").alias("id"), F.col("t").alias("translated"), F.lit(1).alias("x"))
    return jobs.normalize_for_model(rows, "translated")


_MODEL_SCORES = "scores AS (SELECT id, " + ", ".join(
    f"1 / (1 + exp(-((length(comment_text) - length(replace(comment_text, '{pair}', ''))) / 2 / "
    f"greatest(length(comment_text), 1)::DOUBLE * 40 - 1))) AS p_{c}, {c} AS y_{c}, 0 AS z_{c}"
    for c, pair in zip(LABELS, ["th", "en", "ou", "ai", "er", "nd"])
) + " FROM comments)"
_EVALUATE_SQL = (
    C + f", {_MODEL_SCORES}, {fx.SQL_LONG}, {_COUNTS.format('0.5')}, {_RANKED}, {_SWEEP}, {_TUNED}, "
    f"e AS (SELECT label, {_F1} AS f1, roc_auc, pr_auc FROM cm JOIN auc USING (label)), "
    "tuned AS (SELECT label, threshold, base.f1 AS half, best.f1 AS top FROM best JOIN base USING (label)) "
    + " UNION ALL ".join(
        f"SELECT {name} AS name, round({value}, 6) AS value FROM {source}"
        for name, value, source in [
            ("'macro_f1'", "avg(f1)", "e"),
            ("'micro_f1'", "2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))", "cm"),
            ("'macro_precision'", "avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0))", "cm"),
            ("'macro_recall'", "avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0))", "cm"),
            ("'subset_accuracy'", f"({_SUBSET})", "(SELECT 1)"),
            ("'hamming_loss'", "sum(fp + fn)::DOUBLE / sum(tp + fp + fn + tn)", "cm"),
            *[(f"label || '_{m}'", m, "e") for m in ("f1", "roc_auc", "pr_auc")],
            ("label || '_threshold'", "threshold", "tuned"),
            ("label || '_f1_at_half'", "half", "tuned"),
            ("label || '_best_f1'", "top", "tuned"),
            ("label || '_gain'", "top - half", "tuned"),
        ]
    )
)


@query("job_evaluate", _EVALUATE_SQL)
def _(spark, d):
    rows = fx.comments(spark, d).withColumnRenamed("comment_text", "comment")
    report, tuned = jobs.evaluate_model(rows, word_model)
    metrics = report.select(F.explode(F.create_map(*[x for c in report.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    limits = tuned.unpivot("label", ["threshold", "f1_at_half", "best_f1", "gain"], "part", "value")
    limits = limits.select(F.concat_ws("_", "label", "part").alias("name"), "value")
    return _rounded(setops.union_same(metrics.select("name", "value"), limits), "value")


@query("job_evaluate_chosen_table", "SELECT count(*) AS rows FROM labels")
def _(spark, d):
    chosen = evaluate.load_eval_table(spark, "labels", {"labels": f"{d}/labels.parquet", "pages": f"{d}/pages.parquet"})
    return chosen.agg(F.count("*").alias("rows"))


@query("balance_known_method", C + "SELECT id, toxic FROM comments WHERE toxic > 0 AND (SELECT count(*) FROM comments WHERE "
       "toxic > 0) <= (SELECT count(*) FROM comments WHERE toxic = 0)")
def _(spark, d):
    """The positives of a balanced table, which all stay if they are the smaller class; an unknown method is refused."""
    rows = fx.comments(spark, d).select("id", "toxic")
    try:
        sample.balance_binary(rows, method="unknown")
    except ValueError:
        return sample.balance_binary(rows, method="downsample").where("toxic > 0")
    raise AssertionError("an unknown method was accepted")


@query(
    "job_translate_report",
    "WITH todo AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch_id FROM "
    "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT batch_id, count(*) AS requested, count(*) AS parsed, "
    "CAST(0 AS BIGINT) AS missing, 0 AS none_parsed FROM todo GROUP BY batch_id",
)
def _(spark, d):
    source = fx.documents(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("comment_text"), F.col("doc_id").alias("place")
    )
    existing = fx.translations(spark, d).select(F.col("id").cast("string").alias("id"), "translated")
    return jobs.translate_new(source, existing, upper_service, fx.PROMPT, order_by=["place"])[1]


@query("job_label_native_rows", _with(WEAK_DOCUMENTS) + "SELECT id, " + ", ".join(LABELS) + " FROM labelled")
def _(spark, d):
    rows = fx.documents(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("comment"))
    return jobs.label_native(rows, fx.LEXICON)[0]


@query(
    "contains_vocab_groups",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(q)') OR regexp_matches(lower(text), 'aa|bb|cc|dd|ee|ff|gg|ll|mm|nn|oo|pp|rr|ss|tt')
    THEN 1 ELSE 0 END AS hit FROM documents""",
)
def _(spark, d):
    hit = weak.contains_vocab(F.col("text"), [], ["(q)", r"([a-gl-pr-t])\1"])
    return fx.documents(spark, d).select("doc_id", hit.alias("hit"))


@query(
    "parse_mixed_lists",
    _with(_BATCHED_DOCS)
    + "SELECT batch_id, CAST(id AS VARCHAR) AS id, lower(lang) AS translated FROM b",
)
def _(spark, d):
    """Lists that also hold a string, a number and a null; ids with white space around them."""
    batched = _batched_docs(spark, d)
    item = F.to_json(F.struct(F.concat(F.lit(" "), "id", F.lit("\n")).alias("id"), F.col("lang").alias("translated")))
    items = F.array_join(F.collect_list(item), ', "junk", 7, null, ')
    return batch.parse_responses(batched.groupBy("batch_id").agg(F.concat(F.lit("["), items, F.lit("]")).alias("response")))
