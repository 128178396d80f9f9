"""Collocations against plain counting, over any partitions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import collocations
from corpuskit.llm.collocations import lockstep, mine, pair_bits, passing, phrase_counts, word_hashes

SCHEMA = "doc_id long, lang string, text string, f long, a string, phrase string"


def plain_counts(docs):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def plain(docs, min_count, top, within):
    counts, totals = plain_counts(docs)
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < min_count:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10**6 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        longer = [f for (other, w), f in counts.items() if other == lang and len(w) == 3 > len(words) and f >= min_count and words in (w[:2], w[1:])]
        if not any(100 * f >= within * a for f in longer):
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    }


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "a", "Éa", "éa", "new", "york", "new york", "city", "x\x00y", "A", "\x1c", "漢", "state", "b" * 40]
    gaps = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", ";"]
    def text():
        return "".join(rng.choice(words[: rng.choice([4, 15])]) + rng.choice(gaps) for _ in range(rng.randrange(40)))
    return [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_equals_plain_counting(spark, partitions, monkeypatch):
    docs = random_docs(partitions, 250) + [("en", None), (None, ""), ("fr", "one two three"), ("xx", "...")]
    docs += [("en", "hot phrase here " * 5000 + "tail")] + [("en", docs[0][1])] * 20
    rows = [(i, lang, text, 1, "clash", None) for i, (lang, text) in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # phrases cross many partitions
    try:
        for min_count, top, within in ((3, 2000, 50), (8, 4, 30), (1, 50, 100)):
            found = mine(df, min_count, top, within)
            assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            assert {tuple(r) for r in found.collect()} == plain(docs, min_count, top, within)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_partial_counts_and_blocks(spark, monkeypatch):
    """Tasks that hand out counts many times, texts in small blocks, and a filter that lets everything pass."""
    docs = random_docs(9, 80)
    counts, totals = plain_counts(docs)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    monkeypatch.setattr(collocations, "HELD_WORDS", 50)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    for limit in (collocations.FILTER_BITS, collocations.BLOCK_BITS):
        monkeypatch.setattr(collocations, "FILTER_BITS", limit)
        grams, words = phrase_counts(df, 2)
        found = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in grams.collect()}
        assert found == {k: f for k, f in counts.items() if f >= 2}
        assert {r.lang: r.n for r in words.collect()} == dict(totals)


def test_filter_knows_its_pairs():
    words = [b"w%d" % i for i in range(3000)]
    hashes = word_hashes("en", words)
    flags = np.zeros(1 << 19, np.uint8)
    for places in pair_bits(hashes[:-1], hashes[1:], 19):
        flags[places.astype(np.int64)] = 1
    packed = np.packbits(flags, bitorder="little")
    assert passing(packed, hashes[:-1], hashes[1:], 19).all()
    assert passing(packed, hashes[1:], hashes[:-1], 19).mean() < 0.01
    assert not (word_hashes("de", words) == hashes).any()


def test_lockstep_over_single_row_partitions(spark):
    rows = [("en", "a", "", "", 9, 1), ("en", "a", "b", "", 7, 2), ("en", "b", "", "", 8, 3), ("en", "a", "b", "c", 5, 4)]
    rows += [("en", "a", "b", x, 3, 5) for x in "defghij"] + [("en", "c", "", "", 6, 6), ("de", "a", "", "", 2, 7)]
    df = spark.createDataFrame(rows, "lang string, a string, b string, c string, f long, more long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {tuple(r)[:4]: tuple(r)[4:] for r in lockstep(df, "w", "p", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found["en", "a", "b", ""] == (7, 2, 9, None, 5)
    assert found["en", "a", "b", "j"] == (3, 5, 9, 7, None)
    assert found["de", "a", "", ""] == (2, 7, None, None, None)


def test_scores_beyond_64_bits(spark):
    numbers = [(4_000_000_000_000_001, 4_000_000_000_000_003, 4_500_000_000_000_007), (10, 10, 10), (10**12, 10**13, 3 * 10**12)]
    df = spark.createDataFrame(numbers, "a long, l long, r long")
    found = [r.q for r in df.select(F.call_function("div", *collocations._product("a", "l", "r")).alias("q")).collect()]
    assert found == [10**6 * a * a // (left * right) for a, left, right in numbers]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mine(df).collect() == []
    assert mine(spark.createDataFrame([(1, None, None, 1, "", "")], SCHEMA)).collect() == []
