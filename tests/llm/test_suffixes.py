"""Repeated substrings against a plain search over all windows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from corpuskit.llm import suffixes


def plain(docs, length):
    first = {}
    for doc_id, data in docs:
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = {}
    for doc_id, data in docs:
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < doc_id:
                gone[p : p + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.setdefault(doc_id, []).append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "délta", "漢字", "epsilon", "of", "the", "x" * 9]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [make(30) for _ in range(4)]
    texts = [None, "", "short", "a" * 300, "a" * 120, "ab" * 100, "ba" * 70]
    while len(texts) < n:
        text = make(rng.randrange(1, 120))
        kind = rng.randrange(5)
        if kind == 0:
            text = texts[rng.randrange(len(texts))] or text
        elif kind == 1:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(shared)[rng.randrange(40) :] + text[at:]
        elif kind == 2:
            old = list(texts[rng.randrange(len(texts))] or "y")
            for _ in range(3):
                old[rng.randrange(len(old))] = "#"
            text = "".join(old)
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 33)])
def test_spans(spark, tmp_path, monkeypatch, seed, length):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rows = [(i * 3, t) for i, t in enumerate(corpus(seed, 120))]
    random.Random(seed).shuffle(rows)
    rows += [rows[5], (4, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, block int").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = {}
    for r in suffixes.repeated_spans(docs, length, block_bytes=3000, bin_bytes=2000).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    want = plain([(float("inf") if i is None else i, (t or "").encode()) for i, t in rows], length)
    want[None] = want.pop(float("inf"))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_kept_texts_keep_columns(spark, tmp_path):
    text = "A sentence that is long enough to count as a repeated passage, été."
    rows = [(5, "x " + text, "en", 1), (2, text + " y", None, None), (9, None, "en", 3), (7, "short", "de", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, data string, block int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.data, r.block) for r in out.collect()}
    assert got == {5: ("x ", "en", 1), 2: (text + " y", None, None), 9: (None, "en", 3), 7: ("short", "de", 4)}
    empty = docs.limit(0)
    assert suffixes.without_repeats(empty).collect() == [] and suffixes.repeated_spans(empty).collect() == []


#: two edges of one passage; their runs share name, sides and the upper 32 bits of their 64-bit digest
PASSAGE = "a passage that very many documents of the table share with one another; no. 1 of them"
EDGES = "0819720650", "0944536707"


def test_edges_of_a_shared_passage(spark, tmp_path):
    rows = [(i, PASSAGE + e) for i, e in enumerate(EDGES)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r[0]: [tuple(r[1:])] for r in suffixes.repeated_spans(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == plain([(i, t.encode()) for i, t in rows], 50)
    assert got[1][0][1] == len(PASSAGE) + 1  # the edges begin alike


@pytest.mark.parametrize("word", [1, 2, 3])
def test_each_32_bits_of_a_digest_tell_runs_apart(monkeypatch, word):
    def narrow(data, seed):
        full = xxhash.xxh3_128_digest(data, seed)
        return bytes(4 * word) + full[4 * word : 4 * word + 4] + bytes(12 - 4 * word)

    monkeypatch.setattr(suffixes, "whole_digest", narrow)
    values = [(PASSAGE + "%010d" % (i * 7919)).encode() for i in range(300)]
    none = np.zeros(len(values), bool)
    ranked = suffixes.Ranked(suffixes.Block(np.arange(len(values)), values, none, none), 50)
    last = np.flatnonzero(np.append(ranked.doc[1:] != ranked.doc[:-1], True))
    entries = ranked.entry[last]
    family = np.stack([ranked.name[entries] >> np.uint64(32), ranked.before[entries], ranked.after[entries]])
    most = np.unique(family, axis=1, return_counts=True)[1].max()
    assert most > 200 and len(set(entries.tolist())) == len(values)
