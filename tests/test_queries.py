"""Every registered raster query against its SQL."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables aren't here")

from tessera.queries import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted(([plain(v) for v in r] for r in frame), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA)
    want = duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got.select(columns).collect()) == rows(want.select(*columns).fetchall())


@pytest.mark.parametrize("n,width", [(13107, 64), (13108, 64), (51282, 64), (120000, 64), (5000, 1), (320, 64)])
def test_plan_text_of_other_sizes(spark, tmp_path, n, width):
    """Levels from under 1 KiB to over 1 GiB: the plan needs the last row and the longest vector only."""
    con = duckdb.connect()
    con.sql(f"CREATE TABLE embeddings AS SELECT {n - 1}::BIGINT AS vec_id, list_transform(range({width}), lambda i: 0.5::FLOAT) AS embedding")
    con.sql(f"COPY embeddings TO '{tmp_path}/embeddings.parquet'")
    got, want = queries()["plan_text"](spark, str(tmp_path)), con.sql(oracle_sql()["plan_text"])
    assert rows(got.collect()) == rows(want.select(*got.columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
