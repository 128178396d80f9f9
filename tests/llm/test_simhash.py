"""SimHash components against all pairs on small tables."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpuskit.llm import simhash as S
from corpuskit.llm.components import components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, most):
    parent = dict(enumerate(range(len(prints))))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


def test_documents(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "Ünder", "x", "y", "z", "ÀB", "q1"]
    texts = [None, "", " \t", "One", "one", "two words", "the\nsame  text again", "The same text again"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        texts += [" ".join(base), " ".join(base), " ".join(base[:-1])]
    texts.append("long " * 70000)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp int, root int")
    got = {r.doc_id: r for r in S.near_duplicates(df).select("doc_id", S.hexadecimal().alias("h"), "component_id").collect()}
    prints = [plain(t) for t in texts]
    assert [got[i].h for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == closure(prints, 2)


@pytest.mark.parametrize("most", [2, 3])
def test_links_with_heavy_buckets(spark, most):
    rng = random.Random(most)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {0, 2**64 - 1, *centres}
    for _ in range(150):  # one large group of near copies, so that its buckets are heavy
        prints.add(centres[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for c in centres[1:]:
        prints.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    rng.shuffle(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(signed, range(len(prints)))), "fp long, root long")
    found = {r.node: r.component for r in components(S.links(df, most)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == closure(prints, most)


def test_allocation_and_grouping():
    cost, thresholds = S.allocate([[0, 5, 9], [0, 1, 20], [0, 1, 3]], 1)
    assert sum(thresholds) == 1 - 3 + 1 and cost == min(1 + 1, 3 + 0)
    import numpy as np

    correlation = np.eye(64)
    correlation[0, 63] = correlation[63, 0] = 0.9
    groups = S.group_bits(correlation, 3)
    assert sorted(sum(groups, [])) == list(range(64)) and any({0, 63} <= set(g) for g in groups)


def test_empty_null_ids_and_ties(spark):
    schema = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "only here"), (2, None)]
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (2, 2)], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(25)] + [(500, i) for i in range(501, 600)] + [(3, 3), (None, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(26)) and all(found[i] == 500 for i in range(500, 600))
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).collect() == []
