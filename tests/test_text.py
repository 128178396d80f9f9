import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text, text_udf
from corpuskit.functions.runs import periodic_stretches
from corpuskit.functions.text_udf import collapse_chunks, first_sentences


def run(spark, step, values):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", step(F.col("t")).alias("t"))
    return [r["t"] for r in out.orderBy("i").collect()]


CASES = [
    (text.remove_wiki_elements, ["1.2.3.4 hi", "12:30, May 5, 2008 (utc)", "{{a}}x", "{{a{{b}}c}}", "[[x]]", "a\n::reply", None],
     ["  hi", " ", " x", " c}}", " ", "a\n reply", None]),
    (text.remove_wiki_elements, ["{{a b}}", "{{a\nb}}"], [" ", "{{a\nb}}"]),
    (text.handle_mentions, ["@ann hi", "a@b", "@a@b", "і@пріт", "(@x)"],
     ["[USER] hi", "a@b", "[USER]@b", "і@пріт", "([USER])"]),
    (text.remove_hashtags, ["#one two", "#тег!", "#"], [" two", "!", "#"]),
    (text.remove_tags, ["<b>x</b>", "a<\nb>c", "<>"], ["x", "ac", "<>"]),
    (text.reduce_repetitions, ["aaaa", "aa", "\U0001f600" * 4, "\n\n\n\n", "!!!??", ""],
     ["aa", "aa", "\U0001f600" * 2, "\n\n\n\n", "!!??", ""]),
    (text.handle_urls_emails, ["see http://a.b/c?d and www.x.y", "me@x.org, you", "@a.b", "a@@b.c x@y", "q@w.e/http://z"],
     ["see [URL] and [URL]", "[EMAIL] you", "@a.b", "[EMAIL] x@y", "[EMAIL]"]),
    (text.handle_phone_numbers, ["+38 067 123 45 67", "(050)123-45-67", "1234567890123", "12345"],
     ["[PHONE]", "[PHONE]", "[PHONE]3", "12345"]),
    (text.remove_newlines_and_whitespace, [" a \n\t b c d\x1ce ", ""], ["a b c d e", ""]),
    (text.remove_nonprintable, ["a\nb\tc d​e­f g", "\U0001fae0x", "ії"], ["abcdef g", "\U0001fae0x", "ії"]),
    (text.normalize_unicode, ["é", "й", "abc", None], ["é", "й", "abc", None]),
    (text.remove_repetitive_chunks, ["go Go go", "a a ab", "ago go go", "", None, "a b a b a b c"],
     ["go", "ab", "ago", "", "", "a b c"]),
    (text.remove_repeated_sentences, ["Hi. hi. HI. Bye!", "One. Two.", "", None], ["Hi. Bye!", "One. Two.", "", None]),
    (text.sanitize_translation, ['a "b"\r\nc ', "", None], ["a 'b' c", "", None]),
    (text.strip_code_fences, ["```json\n[1]\n```", " x ", "```\ny```", "a```"], ["[1]", "x", "y", "a```"]),
    (text.word_count, ["", " a  b\nc ", "x\x1cy"], [0, 3, 2]),
    (text.scrub_pii, ["ann[USER]mail.org a@b.c 0671234567"], [" [EMAIL] [PHONE]"]),
]


@pytest.mark.parametrize("step,given,want", CASES)
def test_steps(spark, step, given, want):
    assert run(spark, step, given) == want


def test_emoji(spark):
    assert run(spark, text.convert_emojis_to_text, ["\U0001f60a ok", "plain"]) == [
        ":smiling_face_with_smiling_eyes: ok", "plain"]
    names = {"\U0001f44d": "up", "\U0001f44d\U0001f3fd": "up_medium"}
    step = lambda c: text.convert_emojis_to_text(c, names)
    assert run(spark, step, ["\U0001f44d\U0001f3fd\U0001f44d"]) == [":up_medium::up:"]


def test_emoji_with_tags_leave_nothing_invisible(spark):
    tagged = lambda base, place: base + "".join(chr(0xE0000 + ord(c)) for c in place) + "\U000e007f"
    flag = "\U0001f3f4"
    family = "\U0001f468\U0001f3fd\u200d\u2764\ufe0f\u200d\U0001f48b\u200d\U0001f468\U0001f3ff"
    given = [f"a{tagged(flag, 'gbeng')}b {tagged(flag, 'gbsct')}", f"{flag} x", tagged("\U0001f44d", "xy"), f"{family}!", "\U000e0067 alone"]
    assert run(spark, text.convert_emojis_to_text, given) == [
        "a:flag_gb_eng:b :flag_gb_sct:", ":waving_black_flag: x", ":thumbs_up_sign_xy:",
        ":man_medium_skin_tone_heavy_black_heart_kiss_mark_man_dark_skin_tone:!", "\U000e0067 alone",
    ]


def test_emoji_sequences(spark):
    given = ["\U0001f44b\U0001f3ff!", "\U0001f1fa\U0001f1e6\U0001f1eb\U0001f1f7", "#\ufe0f\u20e3 7 #", "☎️\u200d❤", "✓ 12", "©®"]
    assert run(spark, text.convert_emojis_to_text, given) == [
        ":waving_hand_sign_dark_skin_tone:!", ":flag_ua::flag_fr:", ":keycap_#: 7 #", ":black_telephone_heavy_black_heart:",
        "✓ 12", ":copyright_sign::registered_sign:"]


def test_only_rows_that_may_change_leave_the_jvm(spark):
    plain = ["Привіт, їжаче! Ґанок — це «добре»…", "été ÄÖß 12 “x”", "ҐЄІЇ ўё Њ"]
    wide = ["и\u0306", "e\u0301", "\u1100\u1161", "\u2126", "\u0340"]
    rows = spark.createDataFrame([(t,) for t in plain + wide], "t string")
    assert [r[0] for r in rows.select(text.needs_nfc(F.col("t"))).collect()] == [False] * 3 + [True] * 5
    assert not any(r[0] for r in rows.select(text.has_emoji(F.col("t"))).collect())
    rng = random.Random(9)
    mixed = ["".join(chr(rng.choice([rng.randrange(32, 0x600), rng.randrange(0x900, 0x3200), rng.randrange(0x300, 0x370)])) for _ in range(6)) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in mixed], "t string").select("t", text.needs_nfc(F.col("t")).alias("n")).collect()
    assert all(r["n"] or unicodedata.is_normalized("NFC", r["t"]) for r in rows)


def _python_steps(value, lower):
    """Direct use of the published patterns on Python's own regex engine."""
    value = re.sub(text.TAG, "", value)
    value = re.sub(text.HASHTAG, "", value)
    value = re.sub(text.EMAIL, "[EMAIL]", re.sub(text.URL, "[URL]", value))
    value = re.sub(text.PHONE, "[PHONE]", value)
    value = re.sub(text.MENTION, "[USER]", value)
    value = value.lower() if lower else value
    value = re.sub(text.REPEATED_CHAR, lambda m: m.group(1) * 2, value)
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", value)).strip()


def test_chain_equals_python_regexes_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").withColumn("raw", F.col("text"))
    for flags in ({}, {"lowercase": True}):
        for row in text.clean_text(docs, "text", **flags).collect():
            assert row["text"] == _python_steps(row["raw"], flags.get("lowercase", False))


def test_pipeline_order_and_docstring_example(spark):
    df = spark.createDataFrame([("@user Check this out https://example.com \U0001f60a",)], "t string")
    assert text.clean_text(df, "t").first()[0] == "[USER] Check this out [URL] :smiling_face_with_smiling_eyes:"
    assert text.clean_for_model(df, "t").first()[0].startswith("[user] check")
    with pytest.raises(ValueError):
        text.clean_text(df, "t", unknown=True)


def test_translation_preset_drops_blank_and_joins_lines(spark):
    rows = [(1, "{{x}}"), (2, None), (3, "a\nb. A\nb. c"), (4, "ok ok ok")]
    df = spark.createDataFrame(rows, "id int, comment_text string")
    got = {r["id"]: r["comment_text"] for r in text.clean_for_translation(df).collect()}
    assert got == {3: "ab. c", 4: "ok"}
    kept = text.clean_for_translation(df, spaces_before_nonprintable=True).where("id = 3").first()
    assert kept["comment_text"] == "a b. c"


def test_translation_preset_runs_its_udf_once(spark):
    df = spark.range(3).selectExpr("id", "cast(id as string) as comment_text")
    plan = text.clean_for_translation(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") + plan.count("ArrowEvalPython[") <= 1 and "ArrowEvalPython" in plan


def _chunks_by_regex(value, repeats=2):
    pattern = re.compile(r"(.+?)(?:\s+\1){%d,}" % repeats, re.IGNORECASE)
    for _ in range(2):
        value = pattern.sub(r"\1", value)
    return value


def test_chunks_equal_the_regex_on_random_text():
    rng = random.Random(7)
    for _ in range(6000):
        letters = rng.choice(["ab ", "ab  \n", "aAb \t\n", " a", "ab \n", "aab  ", "abc d", " \t\na"])
        value = "".join(rng.choice(letters) for _ in range(rng.randint(0, 24)))
        repeats = rng.choice([2, 2, 3])
        assert collapse_chunks(value, repeats) == _chunks_by_regex(value, repeats), repr(value)
    for _ in range(1500):
        words = [rng.choice(["a", "b", "ab", "ba", "go"]) for _ in range(3)]
        gaps = [" ", " ", "  ", "\n"]
        value = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(3, 30)))
        assert collapse_chunks(value) == _chunks_by_regex(value), repr(value)


def _plain_stretches(codes, smallest, copies, slack):
    found = set()
    for period in range(smallest, len(codes)):
        same = [a == b for a, b in zip(codes, codes[period:])] + [False]
        begin = None
        for k, equal in enumerate(same):
            if equal and begin is None:
                begin = k
            if not equal and begin is not None:
                if k - begin >= copies * period - slack:
                    found.add((begin, k, period))
                begin = None
    return found


def test_periodic_stretches_equal_a_plain_search():
    rng = random.Random(3)
    for _ in range(1500):
        codes = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 50))]
        if rng.random() < 0.5:
            codes += codes[: rng.randrange(1, 8)] * rng.randrange(1, 9) + codes[: rng.randrange(5)]
        copies = rng.choice([2, 3])
        got = {tuple(s) for s in periodic_stretches(np.array(codes), 2, copies, 2).tolist()}
        assert got == _plain_stretches(codes, 2, copies, 2), codes


def test_chunks_of_few_distinct_words_take_near_linear_time():
    """Runs of every length: Fibonacci words, random words of two letters, one word, many copies of a long unit."""
    rng = random.Random(8)
    a, b = ["x"], ["x", "y"]
    while len(b) < 150_000:
        a, b = b, b + a
    unit = " ".join(rng.choice("pqrstuvw") for _ in range(3000))
    for value, limit in ((" ".join(b), 30), (" ".join(rng.choice("ab") for _ in range(200_000)), 15), ("w " * 100_000, 15)):
        start = time.perf_counter()
        collapse_chunks(value)
        assert time.perf_counter() - start < limit
    assert collapse_chunks(" ".join([unit] * 20)) == collapse_chunks(unit)


def test_chunks_stay_fast_on_long_periodic_text():
    assert collapse_chunks("word " * 20000).strip() == "word"
    assert collapse_chunks("a b c " * 5000).strip() == "a b c"


@pytest.mark.parametrize("step", [text.reduce_repetitions, text.handle_urls_emails,
                                  text.remove_newlines_and_whitespace, text.normalize_unicode, text.lowercase])
def test_idempotent(spark, small, step):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(step(F.col("text")).alias("t"))
    assert docs.where(~step(F.col("t")).eqNullSafe(F.col("t"))).count() == 0


def test_first_sentences():
    assert first_sentences("A b.  a B. c? C?") == "A b. c?"


def test_translation_preset_evaluates_its_chain_once(spark):
    df = spark.createDataFrame([(0, "Hi. hi. you"), (1, " \n"), (2, None)], "i int, comment_text string")
    for chunks in (True, False):
        out = text.clean_for_translation(df, remove_repeated_chunks=chunks)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("(?=[+(") <= 1 and plan.count(r"(?=[\p{C}") == 1
        assert [tuple(r) for r in out.collect()] == [(0, "Hi. you")]


def test_arrow_steps_hold_a_slice_of_a_batch(spark):
    kept = text_udf.arrow_steps(["nfc"]).func(iter([pa.array(["e\u0301", None] * text_udf.SLICE)]))
    parts = [next(kept), next(kept)]
    assert [len(p) for p in parts] == [text_udf.SLICE] * 2 and parts[1].to_pylist()[:2] == ["\u00e9", None]


def test_far_repeats_are_not_searched_for_chunks(monkeypatch):
    sizes = []
    search = text_udf.periodic_stretches
    monkeypatch.setattr(text_udf, "periodic_stretches", lambda ids, *rest: sizes.append(len(ids)) or search(ids, *rest))
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(words[:40])
    far = f"{line} {' '.join(words[40:1500])} {line} {' '.join(words[1500:])} {line}"
    assert collapse_chunks(far) == far and not sizes
    long_unit = " ".join(words[:50])
    near = f"{far} {' '.join([long_unit] * 3)} end"
    assert collapse_chunks(near) == f"{far} {long_unit} end" and max(sizes) < 300


@pytest.mark.parametrize("repeats", [2, 3])
def test_repeated_units_equal_the_pattern(repeats):
    rng = random.Random(repeats)
    pattern = re.compile(r"(.+?)(?:\s+\1){%d,}" % repeats, re.IGNORECASE)
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 3)):
            unit = [rng.choice("a b c ab xa q".split()) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(1, 6))]
            parts += unit * rng.choice([1, 2, 3, 4])
        value = " ".join(parts)
        assert collapse_chunks(value, repeats) == pattern.sub(r"\1", pattern.sub(r"\1", value)), value
