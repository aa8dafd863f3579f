"""Comparing a query with its SQL."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

BASE = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def connection():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def compare(spark, query, sql):
    df = query(spark, BASE)
    names = sorted(df.columns)
    ours = Counter(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    found = connection().execute(sql)
    theirs_names = [x[0] for x in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs
