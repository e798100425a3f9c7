import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worldloom.operators import compare, graph, heap, history, inherit, inspect, joins, mail, report, rewrite, waifs
from worldloom.sources import census
from worldloom.streaming import ingest

OBJ = "id bigint, name string, flags int, owner bigint, location bigint, parents array<bigint>, children array<bigint>, contents array<bigint>, last_move bigint, anon boolean"
PRO = "oid bigint, name string, slot int, owner bigint, perms int, value_json string"
VER = "oid bigint, name string, verb_index int, owner bigint, perms int, preps int, code array<string>"
WAI = "waif_index bigint, waif_class bigint, owner bigint, props string, propdefs_length int"
J = lambda t, v=None, **k: json.dumps({"type": t, **({"value": v} if v is not None else {}), **k})
CLEAR = J("clear")


def world(spark, objects=(), properties=(), verbs=(), waifs=()):
    o = [(i, f"o{i}" if name is None else name, flags, owner, loc, ps, ch, co, 0, False) for i, name, flags, owner, loc, ps, ch, co in objects]
    p = [(i, n, k, 1, 5, v) for k, (i, n, v) in enumerate(properties)]
    v = [(i, n, k, 1, perms, -1, c) for k, (i, n, perms, c) in enumerate(verbs)]
    return inspect.World(spark.createDataFrame(o, OBJ), spark.createDataFrame(p, PRO), spark.createDataFrame(v, VER), spark.createDataFrame(list(waifs), WAI))


def tree(*rows):
    return [(i, None, 0, 0, -1, ps, None, None) for i, ps in rows]


def test_ancestor_order_is_depth_first(spark):
    w = world(spark, tree((1, []), (2, [1]), (3, [1]), (4, [2, 3]), (5, [5, 4, None, 99])))
    got = {}
    for r in inherit.ancestors(w).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.ancestor_id)
    assert got[4] == [4, 2, 1, 3] and got[5] == [5, 4, 2, 1, 3]


def test_clear_follows_first_parents(spark):
    w = world(spark, tree((1, []), (2, [1]), (3, [2]), (9, [9])), [(1, "a", J("int", "1")), (2, "a", CLEAR), (3, "a", CLEAR), (3, "b", CLEAR), (9, "a", CLEAR), (2, "b", None)])
    got = {(r.oid, r.name): (r.value_from, r.steps) for r in inherit.effective_values(w).collect()}
    assert got == {(2, "a"): (1, 1), (3, "a"): (1, 2), (3, "b"): (2, 1), (9, "a"): (None, None)}


def test_clear_goes_to_the_parent_that_has_the_property(spark):
    """Not to the first parent if only the second has it, by names in any case."""
    w = world(spark, tree((1, []), (2, []), (3, [1, 2]), (4, [3]), (5, [1])), [(2, "Tint", J("string", "red")), (3, "tint", CLEAR), (4, "TINT", CLEAR), (5, "tint", CLEAR)])
    got = {(r.oid, r.name): (r.value_from, r.steps) for r in inherit.effective_values(w).collect()}
    assert got == {(3, "tint"): (2, 1), (4, "TINT"): (2, 2), (5, "tint"): (None, None)}


def test_plain_names_come_before_waif_spellings(spark):
    w = world(spark, tree((1, []), (2, [1]), (3, [])), (), [(1, "turn", 5, ["a"]), (2, ":turn", 5, ["b"]), (3, ":turn", 5, ["c"])])
    assert {(r.id, r.oid, r.verb) for r in inherit.dispatch(w, "turn").collect()} == {(1, 1, "turn"), (2, 1, "turn"), (3, 3, ":turn")}


@pytest.mark.parametrize(("local", "seed"), [(0, 1), (0, 2), (50_000, 1), (50_000, 3)])
def test_first_holder_against_the_walk(spark, seed, local):
    r = random.Random(seed)
    n = 60
    parents = {i: [r.randrange(n if r.random() < 0.05 else max(1, i)) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for i in range(n)}
    holders = r.sample(range(n), 8)
    want = {}
    for i in range(n):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x in seen:
                continue
            seen.add(x)
            if x in holders:
                want[i] = x
                break
            todo += reversed(parents[x])
    w = world(spark, tree(*parents.items()))
    got = inherit.first_holder(w, spark.createDataFrame([(h,) for h in holders], "oid bigint"), local)
    assert {x.id: x.oid for x in got.collect()} == want


def test_removal_rules(spark):
    """Descendants go, contents only if younger and no players; lists of the rewrite are told from references."""
    objs = [(1, "root", 0, 5, -1, [], [2], [3, 4, 6]), (2, None, 0, 5, 5, [1], [], [7]), (3, None, 0, 5, 1, [], [], []), (4, None, 1, 5, 1, [], [], []), (5, None, 0, 1, 4, [], [], []), (6, None, 0, 5, 1, [], [], []), (7, None, 0, 5, 2, [], [], [])]
    props = [(i, "creation_time", J("int", str(t))) for i, t in ((1, 10), (3, 10), (4, 99), (6, 9), (7, 20))] + [(5, "owned_objects", J("list", items=[json.loads(J("obj", "3"))])), (5, "friend", J("obj", "7"))]
    w = world(spark, objs, props)
    chosen = w.objects.filter("id = 1").select("id")
    assert {r.id for r in graph.removed(w, chosen).collect()} == {1, 2}
    assert {r.id for r in graph.removed(w, chosen, True).collect()} == {1, 2, 3, 7}
    got = {tuple(r) for r in graph.removal(w, chosen, True).collect()}
    assert got == {("inbound", 1, "owner", 1), ("inbound", 1, "location", 2), ("stranded", 1, "location", 2), ("dropped", 3, "property", 1), ("inbound", 7, "property", 1)}


def test_waifs_by_slot_values(spark):
    """Names count over the class's own slots, then its ancestors'; unset slots show the class's value."""
    s = lambda *p: json.dumps([[i, json.loads(v)] for i, v in p])
    props = [(1, ":mood", J("string", "calm")), (2, ":rank", J("int", "0")), (2, ":mood", CLEAR)]
    ws = [(1, 2, 1, s((0, J("int", "7"))), 2), (2, 2, 1, s((1, J("string", "wild"))), 2), (3, 2, 1, None, 2), (4, 9, 1, s((0, J("int", "1"))), 2), (1, 2, 1, s((0, J("int", "7"))), 2)]
    w = world(spark, tree((1, []), (2, [1]), (9, [])), props, (), ws)
    assert {tuple(r) for r in waifs.slot_names(w).collect()} == {(2, 0, "rank"), (2, 1, "mood")}
    root = w.objects.filter("id = 1").select("id")
    assert {tuple(r) for r in waifs.grouped(w, root, [("Rank", True)]).collect()} == {(2, "true", 1), (2, "false", 2)}
    calm = waifs.grouped(w, None, [("mood", False)], [("mood", "^c", False)])
    assert [(r.waif_class, json.loads(r.by_0)["value"], r.n_waifs) for r in calm.collect()] == [(2, "calm", 2)]
    assert {tuple(r) for r in waifs.grouped(w, None, [(1, True)], [("mood", "^c", True)]).collect()} == {(2, "true", 1), (9, "none", 1)}


def test_grep_by_verb_and_owner(spark):
    w = world(spark, tree((1, [])), (), [(1, "loo*k see", 5, ["Return 1;", "x"]), (1, "go", 5, ["return 2;"])])
    assert [(r.verb, r.line) for r in inspect.grep(w, "return", verb="look", ignore_case=True).collect()] == [("loo*k see", "Return 1;")]
    assert [tuple(r) for r in inspect.grep_summary(inspect.grep(w, "(?i)return"), "verb_owner").collect()] == [(1, 2, 2)]


def test_renumbered_lists_values_and_owners(spark):
    v = J("list", items=[json.loads(J("obj", "3")), json.loads(J("obj", "5")), json.loads(J("obj", "-1")), json.loads(J("string", "#5"))])
    w = world(spark, [(0, None, 0, 3, -1, [3, 5], [3, 5, 3], [5, 9])] + [(i, None, 0, 0, 0, [], [], None) for i in (3, 5)], [(0, "p", v), (5, "q", ' { "value" : "0", "type":"obj" } '), (5, "r", "[1")], [(5, "v", 5, ["x"])])
    gone = w.objects.filter("id = 3").select("id")
    first = [r for r in rewrite.renumbered(w, gone).collect() if r.id == 0][0]
    assert (first.parents, first.children, first.contents) == ([-1000003, 1], [1], [1, -1000009])
    assert {r.id for r in rewrite.renumbered(w, gone, keep_numbers=True).collect()} == {0, 5}
    assert [tuple(r) for r in rewrite.renumbered_members(w, gone, "verbs").collect()] == [(1, "v", -1000001)]
    got = {r.name: r.value_json for r in rewrite.renumbered_values(w, rewrite.renumbering(w, gone), -9).collect()}
    assert [x["value"] for x in json.loads(got["p"])["items"]] == ["-12", "1", "-1", "#5"] and got["q"] == ' { "value" : "0", "type":"obj" } ' and got["r"] == "[1"


def test_dispatch_takes_the_nearest(spark):
    w = world(spark, tree((1, []), (2, [1]), (3, [1])), (), [(1, "l*ook x", 5, ["a"]), (3, "look", 5, []), (2, "other", 5, None)])
    assert {(r.id, r.oid) for r in inherit.dispatch(w, "lo").collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r.id, r.oid) for r in inherit.dispatch(w, "look").collect()} == {(1, 1), (2, 1), (3, 3)}


def test_edges_searches_and_cycles(spark):
    props = [(1, "p", J("list", items=[json.loads(J("obj", str(n))) for n in (2, 3)])), (2, "p", J("obj", "4")), (3, "p", J("obj", "4")), (4, "p", J("obj", "1")), (5, "p", J("obj", "77"))]
    w = world(spark, [(i, None, 1 if i == 1 else 0, -1, None, [], [], []) for i in range(1, 6)], props)
    e = graph.edges(w).filter("kind = 'property'")
    assert e.count() == 6
    root = w.objects.filter("id = 1").select("id")
    assert {tuple(r) for r in graph.neighbourhood(e, root).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    assert {tuple(r) for r in graph.neighbourhood(e, root, 1).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {r.id: r.path for r in graph.shortest_paths(e, root, 5).collect()}[4] == "1/2/4"
    assert [r.dst for r in graph.status(w, e).filter("status = 'dangling'").collect()] == [77]
    assert [r.id for r in graph.unreachable(w).collect()] == [5]


def test_tree_summary_counts_repeats_and_missing(spark):
    w = world(spark, [(1, None, 0, 0, -1, [], [2, 2, 3, 99, 1], None), (2, None, 0, 0, 3, [], [], None), (3, None, 0, 0, 2, [], None, None), (4, None, 0, 0, 1, [], None, None)])
    got = {r.root: tuple(r)[1:] for r in graph.tree_summary(w).collect()}
    assert got == {1: (2, 2, 2, 1, 1, 2), 2: (0,) * 6, 3: (0,) * 6, 4: (0,) * 6}
    assert [r.root for r in graph.tree_summary(w, "children", w.objects.filter("id = 1").selectExpr("id AS root")).collect()] == [1]
    assert {r.id: r.top for r in graph.outermost(w).collect()} == {1: 1, 2: None, 3: None, 4: 1}


def test_grep_rules(spark):
    code = ["a = 1;", 'say("a wizard");', "wizard();"]
    w = world(spark, [(1, None, 4, 0, -1, [], [], []), (2, None, 0, 0, -1, [], [], [])], (), [(1, "v", 5, code), (2, "w", 1, ["wizard"]), (2, "none", 5, None), (2, "empty", 5, [])])
    lines = lambda **k: sorted((r.oid, r.line_no) for r in inspect.grep(w, "wizard", **k).collect())
    assert lines() == [(1, 2), (1, 3), (2, 1)] and lines(code_only=True) == [(1, 3), (2, 1)] and lines(executable=True) == [(1, 2), (1, 3)] and lines(exclude=["say"]) == [(2, 1)] and lines(require=["say", "a ="]) == [(1, 2), (1, 3)]
    assert [r.name for r in inspect.without_match(w, "wizard").collect()] == []
    assert lines(wizard_owned=True) == [(1, 2), (1, 3), (2, 1)]


def test_references_do_not_look_into_strings(spark):
    v = J("list", items=[json.loads(x) for x in (J("int", "7"), J("string", '{"type":"obj","value":"7"}'), J("obj", "7"), J("map", entries=[{"key": json.loads(J("obj", "7")), "value": json.loads(J("list", items=[json.loads(J("obj", "7"))]))}]))])
    w = world(spark, tree((7, [])), [(7, "p", v), (7, "q", None), (7, "r", "bad")])
    assert sorted(r.path for r in inspect.references(w, w.objects.select("id")).collect()) == ["list:3", "list:4/map:1:key", "list:4/map:1:value/list:1"]


def test_empty_world(spark):
    w = world(spark)
    for df in (inspect.headers(w), inspect.census(w, "owner"), inspect.slot_totals(w), inspect.value_nodes(w), graph.edges(w), graph.unreachable(w), inherit.effective_values(w), inherit.ancestors(w), waifs.slots(w), waifs.holders(w), compare.object_events(w, w), compare.verb_pairs(w, w), compare.added_lines(w, w), rewrite.renumbering(w, w.objects.select("id"))):
        assert df.collect() == []


def test_program_changes(spark):
    old = world(spark, tree((1, [])), (), [(1, "keep", 5, ["a"]), (1, "edit", 5, ["a", "b", " c"]), (1, "gone", 5, ["x"]), (1, "meta", 5, ["m"])])
    new = world(spark, tree((1, [])), (), [(1, "fresh", 5, ["n"]), (1, "keep", 5, ["a"]), (1, "edit", 5, ["a", "  c", "d"]), (1, "meta", 13, ["m"])])
    assert {(r.name, r.change) for r in compare.verb_pairs(old, new).collect()} == {("fresh", "added"), ("gone", "removed"), ("edit", "code"), ("meta", "meta")}
    assert {(r.name, r.line_no, r.line) for r in compare.added_lines(old, new).collect()} == {("fresh", 1, "n"), ("edit", 3, "d")}
    d = {r.name: (r.n_added, r.n_removed) for r in report.source_diffs(old, new).collect()}
    assert d == {"fresh": (1, 0), "gone": (0, 1), "edit": (2, 2)}
    page = report.markdown(report.source_diffs(old, new)).collect()[0].page
    assert page.index("## edit") < page.index("## fresh") < page.index("## gone")
    assert {(r.name, r.match, r.similarity) for r in compare.program_matches(old, new, 0.3).collect()} == {("keep", "exact", 1.0), ("edit", "similar", 0.5), ("meta", "exact", 1.0), ("gone", "new", None)}


def test_programs_are_found_across_the_world(spark):
    """Under other numbers, without footers, by aliases in any case, and as brute force finds them."""
    r = random.Random(6)
    code = lambda: [r.choice("abcdefgh") for _ in range(r.randrange(1, 7))]
    old = world(spark, tree((1, []), (2, [])), (), [(r.randrange(1, 3), f"{r.choice(['go', 'Stop x', 'look'])} v{i}", 5, code()) for i in range(25)] + [(1, "foot", 5, ["only here;", '"Last modified Mon by A";'])])
    new = world(spark, tree((8, [])), (), [(8, f"{r.choice(['GO', 'stop y', 'LOOK'])} w{i}", 5, code()) for i in range(25)] + [(8, "other", 5, ['  only here; ', '  "Last modified Tue by B";'])])
    lines = lambda c: [x.strip() for x in c if x.strip() and not x.strip().startswith('"Last modified ')]
    a, b = ([(v.name, lines(v.code)) for v in w.verbs.collect()] for w in (old, new))

    def alike(x, y):
        common = sum(min(x.count(t), y.count(t)) for t in set(x))
        return common / (len(x) + len(y) - common)

    want = {}
    for name, x in a:
        if any(x == y for _, y in b):
            want[name] = ("exact", 1, 1.0)
            continue
        near = {tuple(y): alike(x, y) for other, y in b if set(name.lower().split()) & set(other.lower().split())}
        near = {k: v for k, v in near.items() if v >= 0.5}
        want[name] = ("similar", len(near), max(near.values())) if near else ("new", 0, None)
    assert {m.name: (m.match, m.n_found, m.similarity) for m in compare.program_matches(old, new).collect()} == want
    assert {"exact", "similar", "new"} == {v[0] for v in want.values()} and want["foot"][0] == "exact"


def test_continuity(spark):
    made = lambda *p: [(i, n, J("int", str(v)) if v is not None else CLEAR) for i, n, v in p]
    a = world(spark, tree((1, []), (2, []), (4, []), (5, [1]), (6, []), (9, [])), made((1, "Born", 7), (2, "born", 8), (4, "born", None), (5, "born", None), (6, "other", 1)))
    b = world(spark, tree((1, []), (2, []), (3, []), (4, []), (5, [1]), (6, [])), made((1, "born", 7), (2, "born", 9), (3, "born", 1), (4, "born", 3), (5, "born", 7), (6, "born", 1)))
    assert {r.id: r.verdict for r in compare.continuity(a, b, "born").collect()} == {1: "same", 2: "reused", 3: "absent", 4: "unproven", 5: "same", 6: "unproven"}


def _numbered(spark, rows):
    o = spark.createDataFrame(list(rows), "id bigint, anon boolean")
    return inspect.World(o, o, o, o)


def test_lifecycle_of_far_apart_numbers(spark):
    """The gaps of both dumps hold nothing to tell and are not spelled out, however wide."""
    far = 1 << 62
    old = _numbered(spark, [(0, False), (7, True), (far, None)])
    new = _numbered(spark, [(1, False), (7, False), (far + 1, True), (far + 3, False)])
    want = {(0, "present", "recycled", "changed"), (1, "recycled", "present", "changed"), (7, "absent", "present", "added")}
    want |= {(far, "present", "recycled", "changed"), (far + 2, "absent", "recycled", "changed"), (far + 3, "absent", "present", "added")}
    assert {tuple(r) for r in compare.lifecycle(old, new).collect()} == want


@pytest.mark.parametrize(("n", "m"), [(30, 33), (30, 0), (0, 30), (100, 30_000), (30_000, 9_000)])
def test_lifecycle_against_every_number(spark, n, m):
    r = random.Random(n + m)
    dumps = [{i: r.choice([True, False, None]) for i in range(k) if r.random() < 0.6} for k in (n, m)]

    def state(d, i):
        if i in d:
            return "absent" if d[i] else "present"
        return "recycled" if i <= max((j for j, anon in d.items() if not anon), default=-1) else "absent"

    every = [(i, *(state(d, i) for d in dumps)) for i in range(max(n, m))]
    want = [(i, a, b, "changed" if "recycled" in (a, b) else "added" if a == "absent" else "removed") for i, a, b in every if a != b]
    assert sorted(tuple(x) for x in compare.lifecycle(*(_numbered(spark, d.items()) for d in dumps)).collect()) == want


def test_renumbering(spark):
    w = world(spark, [(0, None, 0, 2, -1, [], [], []), (1, None, 0, 0, 3, [0, 3, 0, None], [], []), (3, None, 0, 3, 0, None, [], []), (5, None, 0, 3, 9, [], [], [])])
    got = {r.id: (r.owner, r.location, r.parents) for r in rewrite.renumbered(w, w.objects.filter("id = 3").select("id"), owner_to=0).collect()}
    assert got == {0: (-1000002, -1, []), 1: (0, -1000003, [0, -1000003, 0, None]), 2: (0, -1000009, [])}


def test_as_of_against_brute_force(spark):
    r = random.Random(1)
    t = lambda: r.choice([None, *[datetime(2024, 1, 1, r.randrange(24)) for _ in range(4)]])
    left = [(i, r.choice([1, 2, None]), t()) for i in range(60)]
    right = [(r.choice([1, 2, None]), t(), r.randrange(100)) for _ in range(40)]
    a, b = spark.createDataFrame(left, "i int, k int, at timestamp"), spark.createDataFrame(right, "k int, when timestamp, v int")
    got = {x.i: x.v for x in joins.as_of(a, b, ["k"], "at", "when", ["v"]).collect()}
    best = lambda k, at: max(((w, v) for kk, w, v in right if kk == k is not None and w and at and w <= at), default=(0, None))[1]
    assert got == {i: best(k, at) if k is not None else None for i, k, at in left}


def test_dense_numbers_and_pages(spark):
    df = spark.range(1000).selectExpr("id * 7 AS k").repartition(5)
    assert [(r.k, r.number) for r in joins.dense_numbers(df, "k").orderBy("k").collect()] == [(7 * i, i) for i in range(1000)]
    assert joins.dense_numbers(df.limit(0), "k").collect() == []
    p = joins.page(df, ["k"], 990, 20).collect()
    assert len(p) == 10 and p[0].total == 1000
    assert [r.k for r in joins.in_ranges(df, "k", [(0, 7), (7, 14)]).orderBy("k").collect()] == [0, 7, 14] and joins.in_ranges(df, "k", []).count() == 0


def test_heap_pairs_need_one_partner(spark):
    s = lambda rows: spark.createDataFrame(rows, "place string, id bigint")
    e = lambda rows: spark.createDataFrame(rows, "src bigint, place string, dst bigint")
    got = heap.correspond(s([("a", 1), ("b", 2), ("c", 2)]), s([("a", 10), ("b", 20), ("c", 21)]), e([(1, "x", 3), (3, "x", 3)]), e([(10, "x", 30), (30, "x", 30)]))
    assert {tuple(r) for r in got.collect()} == {(1, 10), (3, 30)}


def test_waif_slots_and_holders(spark):
    props = [(1, "p", J("waif", "4"))]
    ws = [(4, 9, 1, json.dumps([[0, {"type": "waif", "value": "5"}], [3, {"type": "int", "value": "1"}]]), 4), (5, 9, 1, json.dumps([[1, {"type": "waif", "value": "4"}]]), 4), (6, 9, 1, None, 4), (7, 9, 1, '[[1,{"type"', 4)]
    w = world(spark, tree((1, [])), props, (), ws)
    assert {tuple(r) for r in waifs.holders(w).collect()} == {(1, 4), (1, 5)}
    assert waifs.slots(w).count() == 3 and tuple(waifs.sparse_share(w).collect()[0]) == (9, 4, 3, 16)


def test_bundle_round_trip(spark, tmp_path):
    ev = spark.createDataFrame([(1, "a", "x" * 9000), (1, "a", "y"), (2, None, None), (2, "|", "z"), (2, "||", "z")], "oid bigint, field string, text string")
    path = str(tmp_path / "b")
    assert report.write_bundle(ev, path, ["oid", "field"])["n_ids"] == 5
    assert report.read_bundle(spark, path, ["oid", "field"]).count() == 5
    slim, pay = report.externalized(ev, "text")
    assert pay.count() == 1 and slim.filter("text_digest IS NOT NULL AND text IS NULL").count() == 1
    sp = report.spans(ev, "oid", ["field", "text"]).orderBy("oid", "start").collect()
    assert sp[0].start == 0 and sp[1].start == sp[0].size and sp[0].size == len(sp[0].line.encode()) + 1
    report.identified(ev.limit(1), ["oid", "field"]).write.mode("overwrite").parquet(path + "/events")
    with pytest.raises(ValueError):
        report.read_bundle(spark, path, ["oid", "field"])


def test_history(spark):
    d = spark.createDataFrame([(3, "live", datetime(2024, 1, 1)), (4, "live", datetime(2024, 1, 2)), (9, "live", datetime(2024, 1, 4)), (5, "mirror", datetime(2024, 1, 3))], "snapshot_id int, world string, taken_at timestamp")
    assert [tuple(r) for r in history.chain_pairs(d).orderBy("new_id").collect()] == [(3, 4, 24), (4, 9, 48)]
    rows = spark.createDataFrame([(1, datetime(2023, 1, 1)), (2, datetime(2024, 1, 3)), (3, datetime(2025, 1, 1)), (4, None)], "i int, at timestamp")
    assert {r.i: r.snapshot_id for r in history.dump_at(rows, "at", d).collect()} == {1: None, 2: 4, 3: 9, 4: None}
    p = [(3, 1, "p", J("int", "1")), (4, 1, "p", '{"value": "7", "type": "obj"}'), (9, 1, "p", J("string", J("obj", "7")))]
    df = spark.createDataFrame([(*x, datetime(2024, 1, 1)) for x in p], "snapshot_id int, oid bigint, name string, value_json string, loaded_at timestamp")
    assert {tuple(r) for r in history.presence(df, [3, 4, 9], 7).collect()} == {(1, "p", 4, "appeared"), (1, "p", 9, "disappeared")}


def test_redaction_tells_only_that(spark):
    ev = spark.createDataFrame([(1, "a", "changed"), (1, "b", "changed"), (2, "a", "added"), (None, "a", "x")], "oid bigint, field string, change string")
    got = rewrite.redacted(ev, spark.createDataFrame([(1,), (1,), (5,)], "oid bigint")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "redacted", "redacted"), (2, "a", "added"), (None, "a", "x")]))


def test_mail(spark):
    rows = [(i, i % 2, i, 0 if i == 3 else 1704067200, "A (#1)", "*Builders (#9), B" if i else None, "Subject", ["H: 1"], ["one", None, "Velvet"] if i != 4 else None) for i in range(6)] + [(5, 1, 5, 1704067200, "A (#1)", "*Builders (#9), B", "Subject", ["H: 1"], ["one", None, "Velvet"])]
    m = spark.createDataFrame(rows, "message_id bigint, mailbox_oid bigint, msg_number int, date_unix bigint, sender string, recipients string, subject string, headers array<string>, body array<string>")
    assert {r.message_id for r in mail.select(m, [(0, 1), (4, 5)], "VELVET").collect()} == {0, 1, 5} and {r.message_id for r in mail.select(m, last=1).collect()} == {4, 5}
    assert [tuple(r) for r in mail.lists(m).collect()] == [("Builders", 5)] and mail.headers(m).filter("sent IS NULL").count() == 1


def test_census_files(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    row = lambda o, n, s, **k: json.dumps({"object": o, "name": n, "seq": s, "parent": -1, **k})
    path.write_text("\n".join([row(1, "old", 1), row(1, "new", 2, n_verbs=3), row(2, "b", 3, parent=77, fertile=True), "not json", json.dumps({"block_first": 0, "block_last": 99}), row(3, "p", 4, player=True)]))
    rows, blocks = census.read(spark, str(path))
    assert {r.object: r.name for r in rows.collect()} == {1: "new", 2: "b", 3: "p"} and census.resume_at(blocks, 0).collect()[0].next == 100
    assert [r.object for r in census.rank(rows).collect()] == [2, 1] and [r.object for r in census.incomplete(rows).collect()] == [2]
    census.append(spark.createDataFrame([(100, 199)], "block_first bigint, block_last bigint"), str(tmp_path / "more"))
    assert census.resume_at(census.read(spark, str(tmp_path / "more"))[1], 0).collect()[0].next == 200


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    p = "snapshot_id int, oid bigint, name string, value_json string, loaded_at timestamp"
    add = lambda rows, n: spark.createDataFrame(rows, p).coalesce(1).write.parquet(str(src / n))
    out, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    for n, rows in enumerate([[(1, 1, "a", J("int", "1"), datetime(2024, 1, 2)), (1, 1, "b", None, None)], [(1, 1, "a", J("int", "9"), datetime(2024, 1, 1)), (1, 1, "b", J("int", "2"), datetime(2024, 1, 1))]]):
        add(rows, f"f{n}")
        q = ingest.latest_deliveries(spark.readStream.schema(p).parquet(str(src / "*")), out, ck)
        q.awaitTermination(60)
    got = {r.name: r.h for r in ingest.current(spark, out, 1).collect()}
    from worldloom.functions.values import value_hash

    want = spark.createDataFrame([(J("int", "1"),), (J("int", "2"),)], "v string").select(value_hash("v").alias("h")).collect()
    assert got == {"a": want[0].h, "b": want[1].h}
    ev = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "ev"), ) if (tmp_path / "ev").mkdir() is None else None
    (tmp_path / "ev" / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{m:02d}:00", "event_type": "a", "value": 1.0}) for m in (1, 2, 7, 40)))
    q = ingest.activity(ev).writeStream.outputMode("append").format("memory").queryName("act").start()
    q.processAllAvailable()
    time.sleep(0.5)
    q.stop()
    assert {(r.start.minute, r.n) for r in spark.table("act").collect()} == {(0, 2), (5, 1)}


def test_bounds_tell_what_they_prove(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 5)], "src bigint, dst bigint")
    go = lambda *a, **k: (lambda r: ({(x.id, x.depth) for x in r[0].collect()}, r[1]))(graph.bounded(e, *a, **k))
    assert go(1, 9, 99) == ({(1, 0), (2, 1), (5, 1), (3, 2), (4, 3)}, "complete")
    assert go(1, 9, 99, target=4)[1] == "present" and go(5, 9, 99, target=1)[1] == "missing"
    assert go(1, 1, 99, target=4)[1] == "unknown" and go(1, 9, 2, target=4) == ({(1, 0), (2, 1)}, "unknown")


def test_verdicts(spark):
    old = world(spark, tree((1, []), (2, []), (3, []), (4, [])), (), [(1, "a", 5, ["x", "y"]), (1, "b", 5, ["z"]), (2, "a", 5, ["p", "q"]), (3, "a", 5, ["k"]), (3, "empty", 5, [])])
    new = world(spark, (), (), [(11, "a", 5, ["x", " y "]), (17, "c", 5, ["z"]), (2, "a", 5, ["p", "q", "r"]), (3, "a", 5, ["m"])])
    assert {tuple(r) for r in compare.verdicts(old, new).collect()} == {(1, 2, 2, 0, "have it"), (2, 1, 0, 1, "have a different version"), (3, 1, 0, 0, "new"), (4, 0, 0, 0, "no code")}


def test_numbers_too_large_for_any_column(spark):
    big = "9" * 40
    w = world(spark, tree((1, [])), [(1, "p", J("list", items=[json.loads(J("obj", big)), json.loads(J("obj", "1"))])), (0, "q", J("obj", big)), (1, "s", J("string", f"#{big} #1"))], [(1, "v", 5, [f"#{big} #1"])])
    assert {r.target for r in inspect.references(w).collect()} == {None, 1} and {r.target for r in inspect.code_mentions(w).collect()} == {1}
    for df in (graph.edges(w), inspect.slot_totals(w), inspect.dollar_names(w), inherit.resolve(w, spark.createDataFrame([(f"#{big}",)], "ref string")), rewrite.renumbered_code(w, rewrite.renumbering(w, w.objects.filter("id = 9").select("id")), -9)):
        df.collect()


def test_largest_values_in_canonical_spelling(spark):
    w = world(spark, tree((1, [])), [(1, "b", '{"value":  "xx",\n "type": "string"}'), (1, "a", J("string", "xx")), (1, "c", J("string", "x")), (1, "d", CLEAR), (1, "e", None)])
    assert [(r.name, r.size) for r in inspect.largest_values(w, 2).collect()] == [("a", 30), ("b", 30)]
