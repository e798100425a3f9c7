import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from worldloom.operators import reconcile as R

SCHEMA = "oid bigint, name string, v string, perms int, loaded_at timestamp, bucket int, sign int"
T = lambda m: datetime(2024, 1, 1, 0, m)
fields = lambda: {"value": F.col("v"), "perms": F.col("perms")}


def run(spark, a, b, **how):
    df = lambda rows: spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    return sorted((tuple(x) for x in R.reconcile(df(a), df(b), ["oid", "name"], fields(), **how).collect()), key=str)


def brute(a, b):
    newest = lambda rows: {r[:2]: r for r in sorted(rows, key=lambda r: r[4] or T(0))}
    a, b, out = newest(a), newest(b), []
    for k in {*a, *b}:
        if k not in b:
            out.append((*k, "missing_in_mirror"))
        elif k not in a:
            out.append((*k, "missing_in_live"))
        else:
            out += [(*k, f) for i, f in ((2, "value"), (3, "perms")) if a[k][i] != b[k][i]]
    return sorted(out, key=str)


def copies(n, seed, share):
    r = random.Random(seed)
    a = [(i % 50 if i % 3 else 7, f"n{i}", r.choice(["x", "y", None, ""]), r.choice([1, 2, None]), T(5)) for i in range(n)]
    b = []
    for row in a:
        x = r.random()
        if x < share / 3:
            continue
        b.append((*row[:2], "z", row[3], T(6)) if x < share else row)
    b += [(None, "null key", "x", 1, T(1)), (1, None, None, None, None), (90, "extra", "x", 1, T(1))]
    a.append((1, None, None, 4, None))
    return a, b + b[:3]


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 20, "cells": 24}, {"bucket_rows": 500, "cells": 12, "growth": 2, "rounds": 2}, {"bucket_rows": 500, "cells": 12, "rounds": 1}])
@pytest.mark.parametrize("share", [0.02, 0.9])
def test_against_brute_force(spark, how, share):
    a, b = copies(400, 4, share)
    assert run(spark, a, b, **how) == brute(a, b)


def test_empty_sides(spark):
    a, _ = copies(10, 1, 0)
    assert run(spark, [], []) == []
    assert run(spark, a, []) == brute(a, [])
    assert run(spark, [], a) == brute([], a)


def test_late_rows_supersede(spark):
    a = [(1, "n", "old", 1, T(1)), (1, "n", "new", 1, T(9)), (1, "n", "new", 1, T(9))]
    assert run(spark, a, [(1, "n", "new", 1, T(2))]) == []


def test_a_value_that_went_back_and_forth_differs_by_its_newest_delivery(spark):
    a = [(1, "n", "x", 1, T(1)), (1, "n", "y", 1, T(2))]
    b = [(1, "n", "y", 1, T(1)), (1, "n", "x", 1, T(2))]
    assert run(spark, a, b) == brute(a, b) == [(1, "n", "value")]


def test_tables_and_their_sums(spark):
    r = np.random.default_rng(1)
    kh, rh = r.integers(-(2**62), 2**62, (2, 500))
    row = r.integers(0, 3, 500)
    whole, parts = (np.zeros((3, 60, 4), np.int64) for _ in range(2))
    R._put(whole, row, np.ones(500, np.int64), kh, rh)
    for cut in (slice(0, 200), slice(200, 500)):
        t = np.zeros_like(whole)
        R._put(t, row[cut], np.ones(len(row[cut]), np.int64), kh[cut], rh[cut])
        parts[:, :, 0] += t[:, :, 0]
        parts[:, :, 1:] ^= t[:, :, 1:]
    assert (whole == parts).all()
    R._put(whole, row, -np.ones(500, np.int64), kh, rh)
    assert not whole.any()


@pytest.mark.parametrize("tables", [1, 4096])
def test_most_rows_are_settled_by_peeling(spark, monkeypatch, tables):
    monkeypatch.setattr(R, "OPEN_TABLES", tables)
    a, b = copies(2000, 8, 0.02)
    df = lambda rows: spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).select(R._key_hash(["oid", "name"]).alias("kh"), R._row_hash(fields()).alias("rh"), F.coalesce("loaded_at", F.lit(T(0))).alias("at"))
    keys = R.differing_keys(df(a), df(b), 4).count()
    want = len({x[:2] for x in brute(a, b)})
    assert want <= keys <= want + 2


def test_equal_copies_ship_tables_not_records(spark):
    a = [(i, f"name {i}", f"a value of some length {i}" * 5, 1, T(1)) for i in range(20_000)]
    df = spark.createDataFrame([(*r, 0, 0) for r in a], SCHEMA)
    assert R.reconcile(df, df, ["oid", "name"], fields()).count() == 0
    items = df.select(R._key_hash(["oid", "name"]).alias("kh"), R._row_hash(fields()).alias("rh"), "loaded_at").withColumnRenamed("loaded_at", "at")
    assert R.differing_keys(items, items, 10, cells=24).isEmpty()
