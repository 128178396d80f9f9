"""Byte-level BPE against tiktoken, and exact round trips."""

import hashlib
import random

import public_tokenizers as P
import tiktoken

from corpuskit.llm import byte_bpe as B

FILE = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = B.read_ranks(open(FILE, "rb").read())
TEXTS = [None, "", " ", "a  b\n\n c\t", "The don't we'll été 漢字かな 1234567 <|endoftext|> 😀", "\x00\x01 ﻿ nb\xa0sp", "x" * 3000, "ab" * 4000, "word " * 20000, "ÀÉÎ" * 500]


def test_encoding_equals_tiktoken(spark):
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    codec = B.Codec(RANKS, P.PATTERN)
    rng = random.Random(1)
    parts = ["the", "tion", " ", "  ", "\n", "é", "ß", "12", "'s", "...", "漢", "и", "ж", "\t", "😀", "́", "zq"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()
    for text in (chr(rng.randrange(32, 0xD7FF)) * rng.randrange(1, 9) for _ in range(3000)):
        assert codec.encode(text) == reference.encode_ordinary(text)
    rows = [(i, t, [1], "d") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, TEXTS[3], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, data string")
    ids = B.encode(docs, FILE, P.PATTERN)
    want = sorted((str(i), reference.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids.collect()) == want
    back = B.decode(ids, FILE, P.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back) == sorted((str(i), (t or "").encode()) for i, t, *_ in rows)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    digests = [(str(i), len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for (i, t, *_), x in zip(rows, [reference.encode_ordinary(t or "") for _, t, *_ in rows])]
    assert sorted((str(r[0]), *r[1:]) for r in B.round_trip(docs, FILE, P.PATTERN).collect()) == sorted(digests)
    assert B.round_trip(docs.limit(0), FILE, P.PATTERN).collect() == []
