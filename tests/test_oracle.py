"""Registered queries against DuckDB on the smallest tables; CAPSTRATA_ALL=1 runs every one.

Ordered queries run once more with a tiny task share, so the hot-key plans face the same SQL.
"""
import os
from pathlib import Path

import pytest

from capstrata.plans.catalog import QUERIES
from capstrata.session import SLICES_KEY

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no driver tables")
FAST = ["state_counts", "stage_durations", "voxel_average", "plan_raster", "dedupe_assets", "audit_diff", "record_violations", "room_rectangle"]
SLICED = ["slot_gaps", "stream_timing", "bucket_downsample", "even_sample"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def agree(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, DIR)
    cols = sorted(df.columns)
    rows = df.collect()
    if q.oracle() is None:
        return
    res = con.execute(q.oracle())
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    text = lambda v: repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(text(r[c]) for c in cols) for r in rows) == want


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("CAPSTRATA_ALL") else FAST)
def test_query(spark, con, name):
    agree(spark, con, name)


@pytest.mark.parametrize("name", SLICED)
def test_query_sliced(spark, con, name):
    spark.conf.set(SLICES_KEY, "25")
    try:
        agree(spark, con, name)
    finally:
        spark.conf.unset(SLICES_KEY)
