"""Packing against the tokenizer itself and against the rules of a valid packing."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuskit.llm.packing import ChunkEncoder, best_fit, pack_documents, pack_pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", " lead", "two  spaces", "tail \n", "a\nb c\t d", "é ß 漢字 12 <|endoftext|> x", "  ", "word " * 5000, "x" * 9000, "don't we'll  nb sp em a\x1cb"]


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["the", "of", " ", " ", " ", "\n", "é", "12", "'s", ".", "漢", "\t", " ", "\x1f", "😀"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_chunked_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    encoder = ChunkEncoder(open(PATH, encoding="utf-8").read())
    for text in [t or "" for t in TEXTS] + texts(1, 2000):
        assert encoder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_is_valid_and_whole(spark):
    docs = [(i, t, "x", 0.5) for i, t in enumerate(TEXTS + texts(2, 200))] + [(3, TEXTS[3], "x", 0.5), (None, "no id", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, members string, offset double")
    rows = pack_documents(df, PATH, capacity=64).collect()
    whole = Tokenizer.from_file(PATH)
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(r)
    expected = 0
    for doc_id, text, *_ in docs:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(edges, edges[1:])):
            assert found[(doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))].pop()
            expected += 1
    assert expected == len(rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 64) + 2


def test_rounds_merge_what_partitions_leave(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 40) for _ in range(3000)]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], schema)
    rows = pack_pieces(pieces, 100, items_per_task=100, fan_in=2).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 100
    assert len(used) <= math.ceil(sum(sizes) / 100) * 1.01 + 1


def test_items_that_never_share_a_sequence(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = spark.createDataFrame([(i, 0, 0, 60, i) for i in range(500)], schema)
    rows = pack_pieces(pieces, 100, items_per_task=50).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 500
    assert pack_pieces(pieces.limit(0)).collect() == []


def test_the_tree_ends_in_one_partition(spark):
    """Sequences of one 45 each, left in many partitions beside many that nothing fits, still meet."""
    sizes = [60] * 900 + [45] * 41
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], schema)
    used = {}
    for r in pack_pieces(pieces, 100, items_per_task=60, fan_in=2).collect():
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert sum(used.values()) == sum(sizes) and sorted(used.values()) == [45] + [60] * 900 + [90] * 20


def test_best_fit_takes_the_fullest_bin():
    assert best_fit([6, 5, 4, 4, 1], 10) == [[0, 2], [1, 3, 4]]
