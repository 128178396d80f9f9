"""Fingerprints against a plain loop over shingles, and the neighbour order against sorting."""

import hashlib
import random

import numpy as np

from corpuskit.llm import fingerprints as P
from corpuskit.llm.common import window_hashes


def plain(value, fraction):
    if not value:
        return set()
    if len(value) < 16:
        import xxhash

        return {xxhash.xxh64_intdigest(value)}
    hashes = [int(window_hashes(np.frombuffer(value[i : i + 16] + bytes(16), np.uint8), 1)[0]) for i in range(len(value) - 15)]
    return {h for h in hashes if h < 2**64 // fraction} | {min(hashes)}


def test_sketch_merge_and_containment(monkeypatch):
    rng = random.Random(4)
    text = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    values = [b"", b"short", b"exactly 16 bytes", *[text(rng.randrange(400)) for _ in range(50)], text(9000)]
    for chunk in (1 << 20, 500):
        monkeypatch.setattr(P, "CHUNK", chunk)
        assert [set(s.tolist()) for s in P.sketch(values, 8)] == [plain(v, 8) for v in values]
    a, b = P.sketch([values[-1][:6000], values[-1][5000:]], 8)
    assert set(P.merged(a, b, 8).tolist()) == plain(values[-1], 8) - ({int(max(a.min(), b.min()))} if max(a.min(), b.min()) >= 2**61 else set())
    small, large = P.sketch([values[-1][:1500], values[-1]], 8)
    assert P.containment(small, large) > 0.98 and P.resemblance(small, large) < 0.3
    assert P.containment(a[:0], a[:0]) == 1 and P.containment(a, a[:0]) == 0


def test_half_edits(spark):
    rng = random.Random(6)
    texts = [None, "", "é", "ab", "ñandú " * 30, *["".join(rng.choice("abc dé漢") for _ in range(rng.randrange(200))) for _ in range(60)], "z" * 300000]
    ids = rng.sample(range(-500, 500), len(texts))
    rows = [(i, t, 3, "b") for i, t in zip(ids, texts)] + [(ids[7], "again", 1, ""), (ids[8], texts[8], 1, "")]
    for extra in ([], [(None, "no id", 0, None)]):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, bucket int, fingerprint string")
        got = P.half_edits(docs.repartition(5), fraction=4, bucket_bytes=1000).collect()
        order = sorted([(i is not None, i or 0, t or "") for i, t, *_ in rows + extra])
        want = []
        for n, (known, i, t) in enumerate(order):
            after = order[(n + 1) % len(order)][2]
            data = (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
            own, changed, other = P.sketch([t.encode(), data, after.encode()], 4)
            want.append((str(i if known else None), len(t), hashlib.sha256(data).hexdigest(), P.as_text(own), P.as_text(changed), P.containment(own, changed), P.containment(own, other)))
        assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted(want)
    one = spark.createDataFrame([(1, "alone", 0, "")], "doc_id long, text string, bucket int, fingerprint string")
    assert P.half_edits(one).first().near_next == 1.0
    assert P.half_edits(one.limit(0)).collect() == [] and P.fingerprints(one).count() == 1
