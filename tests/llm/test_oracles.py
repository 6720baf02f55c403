"""The corpus queries against their SQL."""

import duckdb
import pytest
from siftwell.llm.oracles import ORACLES
from siftwell.llm.queries import QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, frame.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
