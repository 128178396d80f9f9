"""Lattice scores against all segmentations, counts and base scores against plain loops."""

import math
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import lattice_lm as M
from corpuskit.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for rest in segmentations(word[n:]):
            yield [word[:n], *rest]


def test_marginals_and_expectations():
    pieces = [b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca"]
    share = np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.2, 0.1])
    table, place = M.piece_table(pieces, share)
    p = dict(zip(pieces, share))
    words, times = [b"a", b"abc", b"abcabca", b"cccc", b"bcabcab"], [1, 5, 2, 1, 3]
    counts = Counter()
    for word, n, got in zip(words, times, M.marginals(words, table)):
        options = [(math.prod(p.get(x, 0) for x in s), s) for s in segmentations(word)]
        total = sum(w for w, _ in options)
        assert got == pytest.approx(math.log(total))
        for w, s in options:
            for x in s:
                counts[x] += n * w / total
    expected = M.expected_counts(words, np.array(times), table)[place]
    assert expected == pytest.approx([counts[x] for x in pieces])


def test_vocabulary_spells_everything():
    pieces, weight = M.read_vocabulary(VOCABULARY)
    table, _ = M.piece_table(pieces, weight)
    assert len(set(table.keys.tolist())) == len(pieces) > 20_000 and weight.sum() == pytest.approx(1)
    assert np.isfinite(M.marginals(["漢字é😀".encode(), b"x" * 5000, b"\x01"], table)).all()
    assert table.longest == max(map(len, pieces)) > 16 and all(b" " not in p[1:] for p in pieces)


def brute_scores(texts, learn, vocabulary, steps, share):
    """Scores by enumerating every segmentation of every word."""
    words = [[b" " + w for w in t.encode().lower().split()] for t in texts]
    counts = Counter(w for ws, use in zip(words, learn) if use for w in ws)
    ends = sum(learn)
    pieces, weight = M.read_vocabulary(vocabulary)
    p = dict(zip(pieces, weight))
    for _ in range(steps):
        used = {x: 1.0 if len(x) == 1 else 0.01 for x in pieces}
        for word, n in counts.items():
            options = [(math.prod(p.get(x, 0.0) for x in s), s) for s in segmentations(word)]
            for w, s in options:
                for x in s if w else ():
                    used[x] += n * w / sum(o for o, _ in options)
        total = sum(used.values())
        p = {x: u / total for x, u in used.items()}
    stop = ends / (ends + total)
    tokens = sum(counts.values()) + ends

    def chance(word):
        spelled = math.fsum(math.prod(p.get(x, 0.0) * (1 - stop) for x in s) for s in segmentations(word))
        return share * counts[word] / tokens + (1 - share) * spelled

    return [math.fsum(math.log10(chance(w)) for w in ws) + math.log10(share * ends / tokens + (1 - share) * stop) for ws in words]


@pytest.mark.parametrize("share", [0.0, 0.4])
@pytest.mark.parametrize("frequent", [400_000, 4])
def test_scores_are_sums_over_segmentations(spark, monkeypatch, share, frequent):
    monkeypatch.setattr(M, "FREQUENT", frequent)
    vocabulary = {b" a": 0.2, b" ab": 0.1, b"b": 0.2, b"ab": 0.1, b"bab": 0.1, b" ": 0.1, b"a": 0.1, b" abab": 0.1}
    texts = ["ab abab ba", "ab ab b", "abab a", "babab ab", "bb aba unseen", "", "ab", "ab"]
    learn = [i < 4 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in M.score(docs, docs["doc_id"] < 4, vocabulary, steps=2, word_share=share).collect()}
    want = brute_scores(texts, learn, vocabulary, 2, share)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_other_rows_on_the_second_scan_fail(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    other = F.udf(lambda text: f"{text} {uuid.uuid4()}", "string")  # another text in every evaluation
    with pytest.raises(Exception, match="different rows"):
        M.score(docs.withColumn("text", other("text")), docs["doc_id"] < 0, VOCABULARY).collect()


def plain_base(rows, learn):
    words = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for ws, l in zip(words, learn) if l for w in [*ws, b""])
    tokens, types = sum(counts.values()), len(counts)
    out = []
    for (i, _), ws in zip(rows, words):
        ws = [*ws, b""]
        out.append((str(i), len(ws), sum(counts[w] > 0 for w in ws), tokens, sum(math.log10((counts[w] + 1) / (tokens + types + 1)) for w in ws)))
    return out


@pytest.mark.parametrize("frequent", [400_000, 5])
def test_scores(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(M, "FREQUENT", frequent)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["The", "the", "of", "Ünd", "tion", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\n"), (62, "unseen zzzz words"), (None, "the of"), (63, "x" * 2000), (64, "a\x0bb\x1cc d É")]
    spark.createDataFrame([(i, t, 1.5, "s") for i, t in rows], "doc_id long, text string, score double, word string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    learn = [i is not None and i < 50 for i, _ in rows]
    got = M.score(docs, docs["doc_id"] < 50, VOCABULARY).collect()
    want = plain_base(rows, learn)
    key = lambda r: (r[0], r[1], round(r[4], 6))
    for a, b in zip(sorted([(str(r.doc_id), *r[1:5]) for r in got], key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    known, unknown = (next(r for r in got if r.doc_id == i and r.n_tokens == n) for i, n in ((62, 1), (62, 4)))
    assert unknown.score < known.score
    nothing = M.score(docs, docs["doc_id"] < -1, VOCABULARY).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in nothing)
    assert M.score(docs.limit(0), docs["doc_id"] < 50, VOCABULARY).collect() == []


def test_probabilities_sum_to_at_most_one(spark):
    """Over all words of up to four letters of a two-letter alphabet, after training on some."""
    rows = [(0, "ab ab ba aab"), (1, "ab b")]
    words = [w for n in range(1, 5) for w in ("".join(x) for x in __import__("itertools").product("ab", repeat=n))]
    docs = spark.createDataFrame(rows + [(10 + i, w) for i, w in enumerate(words)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in M.score(docs, docs["doc_id"] < 10, VOCABULARY).collect()}
    end = 10 ** M.score(docs.limit(1), docs["doc_id"] < -1, VOCABULARY).first().score
    assert end > 0
    # each single-word text is word times end
    ends = next(iter(10 ** got[i] for i in got if i >= 10))
    assert ends > 0 and sum(10 ** got[10 + i] for i in range(len(words))) <= 1.0


def test_query_learns_from_training_rows_only(spark, small):
    rows = QUERIES["op9_lattice_lm"](spark, small).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    want = {b[0]: b for b in plain_base(texts, learn)}
    for r in rows:
        b = want[str(r.doc_id)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == b[1:4] and r.base_score == pytest.approx(b[4])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert len(rows) == len(texts)
