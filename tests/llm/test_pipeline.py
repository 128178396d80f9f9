"""The pipeline, stage by stage, against plain versions on a small table."""

import random

import corpus_pipeline as P
from corpuskit.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def rows():
    rng = random.Random(11)
    words = {"en": "the of and house with from this that people water".split(), "de": "der die und das haus mit von ein leute wasser".split()}
    out = []
    for i in range(40):
        lang = "en" if i % 3 else "de"
        out.append((i, " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(30, 90))), lang))
    out += [(40, out[7][1], "en"), (41, out[7][1] + "!", "en"), (42, out[3][1][:150] + " and other words stand here then", "en")]
    out += [(43, None, "en"), (44, "", None), (45, "12 34", None), (46, out[8][1].upper(), None), (None, out[9][1], "de")]
    out += [out[5], (5, "the house of the people and more of this water", "en")]
    return [(i, t, g, "s", len(t or ""), "x") for i, t, g in out]


def test_stages(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = None
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        if name == "language_id":
            assert docs.columns == before.columns
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone == {43, 44, 45}
        elif name == "simhash_near_dedup":
            assert docs.columns == before.columns
            prints = [(r.doc_id, simhash.simhash(r.text.encode())) for r in before.collect()]
            ids = {i for i, _ in prints if i is not None}
            parent = {i: i for i in ids}
            changed = True
            while changed:
                changed = False
                for a, x in prints:
                    for b, y in prints:
                        if a is not None and b is not None and bin(x ^ y).count("1") <= 2 and parent[a] != parent[b]:
                            parent[a] = parent[b] = min(parent[a], parent[b])
                            changed = True
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == sorted(i for i, _ in prints if i is not None and parent[i] == i)
            assert 40 not in {r.doc_id for r in docs.collect()}
        elif name == "suffix_dedup":
            assert docs.columns == before.columns and docs.count() == before.count()
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            assert next(r.text for r in docs.where("doc_id = 42").collect()).endswith(" and other words stand here then")
            kept = sorted(str(r.doc_id) for r in docs.collect())
    assert sorted(str(r.doc_id) for r in docs.where("piece = 0").collect()) == kept


def test_run_and_empty(spark, small, tmp_path):
    assert P.ORACLE_SQL is None
    got = P.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
