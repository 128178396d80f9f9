"""The registered queries against their SQL on the smallest data set."""

import os

import duckdb
import pytest

from corpuskit.plans.catalog import ORACLES, QUERIES

# run by the model tests, or by tools/check.py on larger data
SLOW = {"fit_multilabel"}


@pytest.fixture(scope="module")
def engine(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    return con


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    clean = [tuple(None if v is None or v != v else v for v in r) for r in frame.itertuples(index=False, name=None)]
    return list(frame.columns), sorted(clean, key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, small, engine, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(engine.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0
