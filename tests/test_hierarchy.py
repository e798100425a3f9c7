import random

import pytest

from worldloom.operators import hierarchy as H

SCHEMA = "id bigint, parents array<bigint>, name string"


def brute(rows):
    par = {i: list(dict.fromkeys(p for p in (ps or []) if p is not None)) for i, ps, _ in rows if i is not None}
    first = {i: next((p for p in ps if p in par), None) for i, ps in par.items()}
    out = {}
    for i in par:
        seen, here = [], i
        while here is not None and here not in seen:
            seen.append(here)
            here = first[here]
        root, depth = (seen[-1], len(seen) - 1) if here is None else (-1, -1)
        reach, todo = set(), [p for p in par[i] if p in par]
        while todo:
            x = todo.pop()
            if x not in reach:
                reach.add(x)
                todo += [p for p in par[x] if p in par]
        out[i] = (root, depth, int(i in reach), seen[::-1] if here is None else None)
    return out


def world(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ps = [r.randrange(max(0, i - 3), i) if r.random() < 0.7 else r.randrange(i)] if i and r.random() < 0.9 else []
        if r.random() < 0.1:
            ps.append(r.randrange(n))
        if r.random() < 0.05:
            ps = [10_000 + i, *ps, None]
        rows.append((i, None if r.random() < 0.02 else ps, "x"))
    for a in range(0, 20, 5):  # planted rings
        k = n + a
        rows += [(k + j, [k + (j + 1) % 3], "ring") for j in range(3)] + [(k + 3, [k], "below"), (k + 4, [k + 4, 0], "self")]
    return rows


@pytest.mark.parametrize(("core", "seed"), [(0, 1), (40, 2), (100_000, 1), (100_000, 2)])
def test_against_brute_force(spark, core, seed):
    rows = world(120, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = {r.id: (r.root_id, r.depth, r.on_cycle) for r in H.hierarchy(df, local_core=core).collect()}
    assert got == {i: w[:3] for i, w in want.items()}


@pytest.mark.parametrize("core", [0, 100_000])
def test_paths_and_descendants(spark, core):
    rows = world(60, 3)
    want = brute(rows)
    p = H.paths(spark.createDataFrame(rows, SCHEMA), local_core=core)
    assert {r.id: r.path for r in p.collect()} == {i: w[3] for i, w in want.items()}
    pairs = {(r.ancestor_id, r.id, r.distance) for r in H.descendants(p).collect()}
    assert pairs == {(a, i, len(w[3]) - 1 - k) for i, w in want.items() if w[3] for k, a in enumerate(w[3][:-1])}


def test_deep_chain_contracts_in_few_rounds(spark):
    df = spark.createDataFrame([(i, [i - 1] if i else [], None) for i in range(300)], SCHEMA)
    left = []
    got = {r.id: r.depth for r in H.contract_forest(H.first_existing_parent(df), local_core=0, trace=left).collect()}
    assert got == {i: i for i in range(300)}
    assert len(left) < 40 and left == sorted(left, reverse=True)


def test_rounds_contract_the_test_world_before_anything_is_finished_in_one_task(spark):
    from worldloom.plans.problems import newest_objects

    objects = newest_objects(spark, "/root/testdata/sf0.01")
    n = objects.count()
    left = {}
    assert H.hierarchy(objects, trace=left).count() == n
    assert len(left["forest"]) >= 1 and left["forest"][0] < 0.6 * n
    assert len(left["cycles"]) >= 1 and left["cycles"][0] < 0.6 * n
    whole = {}
    assert H.hierarchy(objects, local_core=0, trace=whole).count() == n
    assert whole["forest"][-1] < 0.1 * n and len(whole["forest"]) > 3


def test_a_ring_ends_as_a_self_loop_however_unlucky_the_coins(spark):
    df = spark.createDataFrame([(i, [(i + 1) % 64], None) for i in range(64)], SCHEMA)
    assert {(r.root_id, r.depth, r.on_cycle) for r in H.hierarchy(df, local_core=0).collect()} == {(-1, -1, 1)}


@pytest.mark.parametrize("core", [0, 10])
def test_empty_nulls_and_lone_rows(spark, core):
    assert H.hierarchy(spark.createDataFrame([], SCHEMA), local_core=core).collect() == []
    df = spark.createDataFrame([(None, [1], "null key"), (1, [None, 7], "parent gone"), (2, None, None)], SCHEMA)
    assert {tuple(r) for r in H.hierarchy(df, local_core=core).collect()} == {(1, 1, 0, 0), (2, 2, 0, 0)}


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, [], 5, 6), (2, [1], 5, 6)], "id bigint, parents array<bigint>, p int, depth int")
    assert {tuple(r) for r in H.hierarchy(df).collect()} == {(1, 1, 0, 0), (2, 1, 1, 0)}


def test_bounded_core_is_contracted_too():
    up = {i: (i - 1 if i else None, 1) for i in range(5000)}
    records, rounds = H._contract(up, lambda upper, _, lower: upper + lower)
    assert rounds < 80 and len(records) == 4999 and up == {0: (None, 1)}
    ring = {i: ((i + 1) % 50, 1) for i in range(50)} | {50: (7, 1)}
    assert len(H._contract(ring, lambda upper, _, lower: upper + lower)[0]) == 50 and len(ring) == 1


def test_components_are_searched_only_in_what_never_contracts():
    tree = [(i, (i - 1) // 2) for i in range(1, 500)]
    ring = [(1000 + i, 1000 + (i + 1) % 9) for i in range(9)]
    core, closed, records = H._contract_edges(tree + ring)
    assert not any(core.values()) and len(closed) == 1 and len(records) >= 8
    knot = [(a, b) for a in range(2000, 2003) for b in range(2000, 2003) if a != b]
    assert set(H._contract_edges(tree + ring + knot)[0]) == {2000, 2001, 2002}


@pytest.mark.parametrize("seed", range(8))
def test_bounded_cycles_against_reachability(seed):
    import pandas as pd

    r = random.Random(seed)
    n = 40
    e = {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(r.choice([35, 45, 60]))) if a != b}
    reach = {x: set() for x in range(n)}
    for _ in range(n):
        for a, b in e:
            reach[a] |= {b} | reach[b]
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in range(n) if x in reach[x]}
    (got,) = H._finish_cycles(iter([pd.DataFrame(sorted(e), columns=["u", "v"])]))
    assert dict(zip(got["id"], got["scc"])) == want
