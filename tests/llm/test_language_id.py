"""Language identification: n-grams against a plain count, decoding by hand, held-out accuracy."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpuskit.llm import language_id as L
from corpuskit.llm.queries import QUERIES


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    values = [b"", b"a", b"Hello World 42", "déjà vu".encode() * 30, b"xyz" * 50]
    whole = Counter()
    for docs, buckets in L.ngram_buckets(values):
        whole.update(zip(docs.tolist(), buckets.tolist()))
    for d, v in enumerate(values):
        assert sum(n for (doc, _), n in whole.items() if doc == d) == sum(max(0, len(v) + 2 - o + 1) for o in L.ORDERS)
    monkeypatch.setattr(L, "CHUNK", 16)
    cut = Counter()
    for docs, buckets in L.ngram_buckets(values):
        cut.update(zip(docs.tolist(), buckets.tolist()))
    assert cut == whole


@pytest.mark.parametrize("count", [2, 4, 6, 12, 40])
def test_codewords_are_apart(count):
    code = L.codewords(count)
    assert set(np.unique(code)) == {-1.0, 1.0} and all(abs(c.sum()) < count for c in code.T)
    least = min((a != b).sum() for a, b in combinations(code, 2))
    assert least >= (1 if count == 2 else 2 ** (count - 2) if count <= 6 else 5)


def test_decoding_corrects_a_wrong_bit():
    code = L.codewords(4)
    model = L.Model(list("abcd"), code, None, np.full(code.shape, 1 / 7))
    scores = code[2:3] * 3.0
    scores[0, 1] *= -1
    assert L._losses(scores, model).argmin() == 2


def test_held_out_accuracy(spark, small):
    lang = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op1_language_id"](spark, small).join(lang, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_defined_results_for_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    train = [(i, t, g, "s") for i, (t, g) in enumerate([("the cat of the house", "en"), ("die katze und das haus", "de"), (None, "en"), ("x", None)] * 3)]
    model = L.fit(spark.createDataFrame(train, schema))
    rows = [(1, None, "en", ""), (2, "", "", ""), (3, "12 -- 34", "", ""), (None, "the house", None, None), (5, "das haus " * 200000, "", ""), (5, "das haus", "", ""), (5, "das haus", "", "")]
    got = L.predict(spark.createDataFrame(rows, schema), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    assert [r.lang_pred for r in got.collect()] == ["und", "und", "und", "en", "de", "de", "de"]
    assert L.fit(spark.createDataFrame([], schema)) is None
    assert [r.lang_pred for r in L.predict(spark.createDataFrame(rows[:4], schema), None).collect()] == ["und"] * 4
    alone = L.fit(spark.createDataFrame([(1, "only one", "en", "")], schema))
    assert [r.lang_pred for r in L.predict(spark.createDataFrame(rows[2:4], schema), alone).collect()] == ["und", "en"]
    assert L.predict(spark.createDataFrame([], schema), model).collect() == []


def plain_losses(text, model):
    """The decoder in plain loops: odds of every n-gram, then the loss of every codeword."""
    framed = b" " + text.encode() + b" "
    buckets = [b for _, found in L.ngram_buckets([text.encode()]) for b in found.tolist()]
    assert len(buckets) == sum(max(0, len(framed) - o + 1) for o in L.ORDERS)
    bits = [sum(float(model.weights[b, j]) for b in buckets) / len(buckets) ** 0.5 for j in range(model.code.shape[1])]
    return [
        sum(model.trust[i, j] * np.log1p(np.exp(-bits[j] * model.code[i, j])) for j in range(len(bits)))
        for i in range(len(model.languages))
    ]


def many_languages(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(30):
        letters = [chr(97 + i) for i in rng.permutation(26)[:9]]
        words = ["".join(rng.choice(letters, rng.integers(2, 6))) for _ in range(30)]
        rows += [(n * 50 + i, " ".join(rng.choice(words, 25)), f"l{n:02d}") for i in range(12)]
    return rows, L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_decoding_equals_plain_loops_and_short_texts_stay(spark):
    rows, model = many_languages(spark)
    texts = [t for _, t, _ in rows[::7]] + [" ".join(t.split()[:2]) for _, t, _ in rows[::5]] + ["ok", "Hello", "q"]
    got = L.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), model).collect()
    flagged = 0
    for row, text in zip(got, texts):
        losses = plain_losses(text, model)
        least, second = sorted(losses)[:2]
        assert row.lang_pred == model.languages[int(np.argmin(losses))]
        assert abs(row.score - 1 / sum(np.exp(least - x) for x in losses)) < 1e-6
        if abs(second - least - 0.05) > 1e-6:
            assert row.ambiguous == (second - least < 0.05)
        flagged += row.ambiguous
    assert flagged <= 0.05 * len(texts), "clear texts are kept, however many languages there are"
    tie = L.Model(["a", "b"], L.codewords(2), np.zeros((L.BUCKETS, 1), np.float32), np.ones((2, 1)))
    row = L.predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), tie).first()
    assert (row.lang_pred, row.score, row.ambiguous) == ("a", 0.5, True)


def test_clashing_columns_stay(spark):
    _, model = many_languages(spark)
    df = spark.createDataFrame([(1, "ab cd", "x", "y", 2)], "doc_id long, text string, language string, __language string, `a.b` int")
    row = L.predict(df, model).first()
    assert (row["language"], row["__language"], row["a.b"]) == ("x", "y", 2)
