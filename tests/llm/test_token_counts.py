"""Token counts against the tokenizer library and against a plain merge loop."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuskit.llm import token_counts
from corpuskit.llm.queries import QUERIES
from corpuskit.llm.token_counts import Counter, Merges, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"
TEXTS = [
    "", " ", "a", " lead", "tail ", "two  spaces", "tab\tand\n new", "don't we'll I'M", "é ß 漢字 12", "x" * 9000, "ab" * 3000,
    "word " * 3000, SPECIAL, f"a {SPECIAL} b", f"{SPECIAL}{SPECIAL}", f"  {SPECIAL}\n{SPECIAL} ", "<|endoftext |>", " nb sp em",
    "a\x1cb \x1f c", "😀😀 👍🏽", "\r\n\r\n x", "1234567 ,,,, ....!",
]


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def random_texts(seed, n, size=60):
    rng = random.Random(seed)
    alphabet = ["the", "of", " ", " ", " ", "\n", "é", "12", "'s", ".", "漢", "\t", " ", "\x1f", "😀", "ing", "qz", SPECIAL]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(size))) for _ in range(n)]


def one_by_one(data, ranks, products):
    """The lowest rank first, its leftmost place first, one merge at a time."""
    data = list(data)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(data, data[1:])) if p in ranks]
        if not found:
            return len(data)
        rank, i = min(found)
        data[i : i + 2] = [products[rank]]


def test_counts_equal_the_library(monkeypatch):
    counter = Counter(open(PATH, encoding="utf-8").read())
    rng = random.Random(5)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0189+/") for _ in range(20000))
    texts = TEXTS + random_texts(1, 1500) + [letters, " ".join(letters[i : i + 7] for i in range(0, 20000, 7))]
    expected = whole(texts)
    assert counter.count(texts) == expected
    counter.prepare(texts)
    assert counter.count(texts) == expected
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 5)  # texts in many blocks
    monkeypatch.setattr(token_counts, "MEMO_CHARS", 3)
    assert Counter(open(PATH, encoding="utf-8").read()).count(texts) == expected


def test_any_merge_rules_in_sequential_order():
    """Rules where a merge makes a pair of a lower rank, and overlapping pairs."""
    rng = random.Random(3)
    for _ in range(300):
        pairs, products, symbols = [], [], 4
        while len(pairs) < 12:
            pair = (rng.randrange(symbols), rng.randrange(symbols))
            if pair in pairs:
                continue
            new = rng.random() < 0.7
            products.append(symbols if new else rng.randrange(4, symbols) if symbols > 4 else symbols)
            symbols = max(symbols, products[-1] + 1)
            pairs.append(pair)
        order = rng.sample(range(12), 12)
        pairs, products = [pairs[i] for i in order], [products[i] for i in order]
        merges = Merges(pairs, products, [b % 4 for b in range(256)])
        data = [bytes(rng.randrange(4) for _ in range(rng.randrange(25))) for _ in range(20)]
        ranks = {p: i for i, p in enumerate(pairs)}
        assert merges.surviving(data).tolist() == [one_by_one(d, ranks, products) for d in data]
    assert Merges([], [], list(range(256))).surviving([b"abc", b"", b"a"]).tolist() == [3, 0, 1]


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    texts = [None, *TEXTS, TEXTS[5]]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, None, None, None), (5, TEXTS[4], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id long")
    found = count_tokens(docs, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    expected = [(r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, whole([r[1] or "" for r in rows]))]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)
    assert count_tokens(docs.limit(0), PATH).collect() == []
    named = spark.createDataFrame([("k", "two words")], "text string, body string")
    assert tuple(count_tokens(named, PATH, "text", "body").first()) == ("k", 9, 2)


def test_query_equals_the_library(spark, small):
    found = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    counts = whole([d.text or "" for d in docs])
    assert len(found) == len(docs) and any(n > 512 for n in counts)
    for doc, n in zip(docs, counts):
        row = found[doc.doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((doc.text or "").encode()), n, n > 512)
    assert np.sum(counts) == sum(r.n_tokens for r in found.values())
