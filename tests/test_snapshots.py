import random
from datetime import datetime

import pytest

from worldloom.operators import snapshots

OBJ = "snapshot_id int, id bigint, name string, owner bigint, location bigint, parents array<bigint>, loaded_at timestamp, key int, pos int"
MEM = "snapshot_id int, oid bigint, slot int, name string, owner bigint, perms int, value_json string, loaded_at timestamp"
VRB = "snapshot_id int, oid bigint, verb_index int, name string, perms int, code array<string>, loaded_at timestamp"
T = lambda m: datetime(2024, 1, 1, 0, m)


def versions(rows, dumps):
    at = {}
    for s, i, n, o, loc, ps, when, *_ in rows:
        if (s, i) not in at or (when or T(0)) > at[s, i][0]:
            at[s, i] = (when or T(0), (n, o, loc, tuple(ps or ())))
    out = []
    for i in {i for _, i in at}:
        run = None
        for s in dumps:
            v = at.get((s, i), (None, None))[1]
            if run and v == run[2]:
                run[1] = s
                continue
            if run:
                out.append((i, run[0], run[1]))
            run = [s, s, v] if v is not None else None
        if run:
            out.append((i, run[0], run[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_against_brute_force(spark, seed):
    r = random.Random(seed)
    dumps = [3, 9, 4, 12]
    rows = []
    for i in [*range(40), None]:
        for s in [*dumps, 99]:
            for _ in range(r.choice([0, 1, 1, 2])):
                rows.append((s, i, r.choice(["a", None]), r.choice([1, None]), 5, r.choice([None, [], [1, 2], [2, 1], [None], [1, None, 2]]), T(len(rows) % 50 + 1), 0, 0))
    got = spark.createDataFrame(rows, OBJ)
    want = [v for v in versions([x for x in rows if x[0] != 99], dumps)]
    assert sorted((tuple(x) for x in snapshots.attribute_versions(got, dumps).collect()), key=str) == want
    small = spark.createDataFrame(rows, OBJ)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted((tuple(x) for x in snapshots.attribute_versions(small, dumps).collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_versions_of_nothing(spark):
    empty = spark.createDataFrame([], OBJ)
    assert snapshots.attribute_versions(empty, [1, 2]).collect() == []
    assert snapshots.attribute_versions(empty, []).collect() == []


def test_superseded_and_repeated_rows_count_once(spark):
    rows = [(1, 1, "old", 1, 1, [], T(1), 0, 0), (1, 1, "new", 1, 1, None, T(2), 0, 0), (1, 1, "new", 1, 1, None, T(2), 0, 0), (2, 1, "new", 1, 1, [], None, 0, 0)]
    assert [tuple(x) for x in snapshots.attribute_versions(spark.createDataFrame(rows, OBJ), [1, 2]).collect()] == [(1, 1, 2)]


def test_versions_with_values(spark):
    rows = [(1, 1, None, 7, 1, [2], T(1), 0, 0), (2, 1, "b", 7, 1, [2], T(1), 0, 0)]
    got = snapshots.attribute_versions(spark.createDataFrame(rows, OBJ), [1, 2], with_values=True).orderBy("first_snapshot_id").collect()
    assert [(x.first_snapshot_id, x.last_snapshot_id, x.name, x.parents) for x in got] == [(1, 1, None, [2]), (2, 2, "b", [2])]


def test_member_changes(spark):
    one, two = '{"type":"int","value":"1"}', '{"value": "1",\n "type": "int"}'
    p = [
        (1, 1, 0, "same", 1, 1, one, T(1)), (2, 1, 3, "same", 1, 9, two, T(1)),  # another spelling is the same value
        (1, 1, 0, "changed", 1, 1, one, T(1)), (2, 1, 0, "changed", 1, 1, '{"type":"obj","value":"1"}', T(1)),
        (1, 1, 0, "late", 1, 1, one, T(1)), (2, 1, 0, "late", 1, 1, None, T(1)), (2, 1, 0, "late", 1, 1, one, T(5)),
        (1, 1, 0, "gap", 1, 1, one, T(1)), (3, 1, 0, "gap", 1, 1, one, T(1)),
        (2, 1, 0, None, 1, 1, None, T(1)), (3, 1, 0, None, 1, 1, "no json", T(1)),
        (2, 5, 0, "new object", 1, 1, one, T(1)), (3, 5, 0, "new object", 1, 1, one, T(1)),
    ]
    v = [(1, 1, 0, "v", 1, None, T(1)), (2, 1, 0, "v", 1, [], T(1)), (3, 1, 0, "v", 1, [""], T(1)), (1, 2, 0, "w", 1, ["a", None], T(1)), (2, 2, 0, "w", 1, ["a", None], T(1)), (3, 2, 0, "w", 1, ["a"], T(1))]
    got = snapshots.member_changes(spark.createDataFrame(p, MEM), spark.createDataFrame(v, VRB), [1, 2, 3]).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(
        [
            ("property", 2, 1, "changed", "changed"), ("property", 3, 1, "changed", "removed"), ("property", 3, 1, "same", "removed"), ("property", 3, 1, "late", "removed"),
            ("property", 2, 1, "gap", "removed"), ("property", 3, 1, "gap", "added"), ("property", 2, 1, None, "added"), ("property", 3, 1, None, "changed"), ("property", 2, 5, "new object", "added"),
            ("verb", 2, 1, "v", "changed"), ("verb", 3, 1, "v", "changed"), ("verb", 3, 2, "w", "changed"),
        ], key=str,
    )


def test_changes_need_two_dumps(spark):
    e = spark.createDataFrame([], MEM), spark.createDataFrame([], VRB)
    assert snapshots.member_changes(*e, [1]).collect() == [] and snapshots.member_changes(*e, [1, 2]).collect() == []
