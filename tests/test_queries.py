"""Every registered query against its DuckDB form, at the smallest scale."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - {"pipeline"}))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows or name in ("op3_license_scan",)
        return
    got = duck.sql(sql)
    at = [got.columns.index(c) for c in columns]
    assert len(at) == len(got.columns)
    assert rows == Counter(tuple(value(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_a_missing_text_has_no_verdict(spark, tmp_path):
    texts = [None, "", "call +1 (415) 555-0100 or a.b@c.org", "Contact: Ann Bee, 415-555-0100, 415.555.0101x", "Contact: Jane.Doe@acme.com", "x" * 100_000 + "@y.org"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["redacted_documents"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.sql(__spark_entry__.oracle_sql()["redacted_documents"]).fetchall())
    assert dict((r.doc_id, r.quarantined) for r in got)[0] is None
