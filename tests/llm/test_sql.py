"""Every query with a SQL twin against DuckDB, over whole tables."""
import decimal
from pathlib import Path

import pytest

from capstrata.llm.queries import LLM_ORACLES, LLM_QUERIES

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = LLM_QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    res = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    plain = lambda v: int(v) if isinstance(v, decimal.Decimal) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want
