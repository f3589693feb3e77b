"""Every registered query against its oracle at the smallest scale."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from kinsight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or (isinstance(x, float) and np.isnan(x)) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x
    return list(frame.columns), sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = rows_of(catalogue.queries()[name](spark, SF).toPandas())
    if name in catalogue.oracles():
        assert got == rows_of(duck.execute(catalogue.oracles()[name]).df())
    else:
        assert got[1]
