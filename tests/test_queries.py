"""Every registered core query against its SQL twin on the smallest tables."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from worldloom import session
from worldloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    session.ship(spark)
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert rows == Counter(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["kind", "snapshot_id", "oid", "name", "change_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
