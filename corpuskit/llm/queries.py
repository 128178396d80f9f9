"""Registered queries of the training-data operators: whole tables, production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import (
    byte_bpe,
    collocations,
    conversation_repair,
    fingerprints,
    html_text,
    language_id,
    lattice_lm,
    neighbours,
    packing,
    simhash,
    suffixes,
    token_counts,
    url_filter,
)
from corpuskit.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1(spark, d):
    docs = table(spark, d, "documents")
    held_out = crc_remainder("doc_id", 5) == 0
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op2_best_fit_packing")
def op2(spark, d):
    packed = packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_multiprobe_neighbours")
def op3(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


@query("op4_suffix_dedup")
def op4(spark, d):
    return suffixes.repeated_spans(table(spark, d, "documents"), length=50)


@query("op5_fingerprints")
def op5(spark, d):
    return fingerprints.half_edits(table(spark, d, "documents"), fraction=fingerprints.FRACTION)


@query("op6_byte_bpe")
def op6(spark, d):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, d, "documents"), ranks, public_tokenizers.PATTERN)


@query("op7_simhash")
def op7(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


# --- Fixed values: the rules of the URL query ---
OP8_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
OP8_SQL = """
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)://(.*)', 1) AS rest FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT page_id, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND place = 1
"""


@query("op8_url_filter", OP8_SQL)
def op8(spark, d):
    rules = spark.createDataFrame(OP8_RULES, url_filter.RULES)
    judged = url_filter.judge(table(spark, d, "pages").select("page_id", "url"), rules, default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_lattice_lm")
def op9(spark, d):
    docs = table(spark, d, "documents")
    held_out = crc_remainder("doc_id", 7) == 2
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    found = lattice_lm.score(docs.select("doc_id", "text"), ~held_out, vocabulary)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_html_text")
def op10(spark, d):
    return html_text.extract(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query("op11_token_counts")
def op11(spark, d):
    counts = token_counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def _option(cost: int, letter: str, end: int, out: str = "") -> str:
    row = f"list_prepend({out}, v[{end}].o)" if out else f"v[{end}].o"
    return f"{{'c': {cost} + v[{end}].c, 'a': '{letter}' || v[{end}].a, 'o': {row}}}"


def _own(state: int) -> str:
    """The least edits that take the row in a state (1 nothing yet, 2 system, 3 user, 4 assistant)."""
    spoken, name = (4, "assistant") if state == 3 else (3, "user")
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[state]
    options = [_option(3, "D", state)]
    for initial, end in kept.items():
        option = _option(0, "K", end, "role || ':' || text").replace("'c': 0", "'c': cut")
        options.append(f"CASE WHEN fault IN ('', 't') AND role[1] = '{initial}' THEN {option} END")
    option = _option(2, "R", spoken, f"'{name}:' || text").replace("'c': 2", "'c': 2 + cut")
    options.append(f"CASE WHEN fault IN ('', 't') THEN {option} END")
    return f"list_min([{', '.join(options)}])"


def _insert(of: str, name: str) -> str:
    return f"{{'c': 2 + {of}.c, 'a': 'I' || {of}.a, 'o': list_prepend('{name}:', {of}.o)}}"


OP12_SQL = f"""
WITH RECURSIVE crcs(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM crcs WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crcs WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM hurt),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair
  FROM placed),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
         coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id),
back(conv_id, i, v) AS (
  SELECT conv_id, n, [{{'c': 0, 'a': '', 'o': []::VARCHAR[]}},
                      {{'c': 4, 'a': 'II', 'o': ['user:', 'assistant:']}},
                      {{'c': 2, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}}]
  FROM convs
  UNION ALL
  SELECT conv_id, i - 1, [list_min([o1, {_insert("b3", "user")}]), list_min([o2, {_insert("b3", "user")}]), b3, b4]
  FROM (SELECT *, list_min([o3, {_insert("o4", "assistant")}]) AS b3, list_min([o4, {_insert("o3", "user")}]) AS b4
        FROM (SELECT b.conv_id, i, {", ".join(f"{_own(s)} AS o{s}" for s in (1, 2, 3, 4))}
              FROM back b JOIN (SELECT *, (fault = 't')::INT AS cut FROM judged) j
              ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND b.i = j.pos)))
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, v[1].c::BIGINT AS cost, v[1].a AS audit,
       sha256(array_to_string(v[1].o, chr(10))) AS repaired_sha256
FROM convs c JOIN back b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 0
"""


@query("op12_conversation_repair", OP12_SQL)
def op12(spark, d):
    damaged = conversation_repair.damage(table(spark, d, "conversations"))
    return conversation_repair.repair(damaged, live_col="live").withColumnRenamed("sha256", "repaired_sha256")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS phrase
  FROM split, (VALUES (1), (2), (3)) sizes(n)),
counts AS (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE n > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.n, c.phrase, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, n)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
inner_pairs AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS longer FROM candidates WHERE n = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE n = 3),
ranked AS (
  SELECT lang, phrase, a, l, r, score::BIGINT AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest c WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM inner_pairs p WHERE p.lang = c.lang AND p.phrase = c.phrase AND 100 * p.longer >= 50 * c.a))
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark, d):
    return collocations.mine(table(spark, d, "documents"), min_count=10, top=2000, within=50)
