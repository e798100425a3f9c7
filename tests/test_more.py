import json
import math
import os
import socket
import struct
import subprocess
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_operators import CLEAR, J, tree, world
from test_textdump import new_dump

from worldloom import __main__ as cli
from worldloom import session
from worldloom.functions.values import close, double_of_bits
from worldloom.operators import export, graph, history, inspect, policy, rewrite, valuediff
from worldloom.sources import commits, live, textdump
from worldloom.sources.tables import live_dumps, table


def test_floats_from_bits(spark):
    xs = [0.0, -0.0, 1.0, -2.5, 0.1, 1e308, 5e-324, 2.2e-308, math.inf, -math.inf, math.nan]
    df = spark.createDataFrame([(struct.pack(">d", x).hex(),) for x in xs], "b string")
    got = [r[0] for r in df.select(double_of_bits("b")).collect()]
    assert all(math.isnan(a) if math.isnan(b) else a == b and math.copysign(1, a) == math.copysign(1, b) for a, b in zip(got, xs))
    c = spark.createDataFrame([(1.0, 1.0 + 1e-12), (1.0, 1.1), (0.0, 1e-13), (None, 1.0)], "a double, b double")
    assert [r[0] for r in c.select(close(F.col("a"), F.col("b"))).collect()] == [True, False, True, None]


def test_node_diffs(spark):
    f = lambda x: {"type": "float", "bits": struct.pack(">d", x).hex()}
    li = lambda *x: json.dumps({"type": "list", "items": list(x)})
    one, obj = json.loads(J("int", "1")), json.loads(J("obj", "1"))
    a = world(spark, (), [(1, "p", li(one, one, f(1.0))), (1, "same", li(one)), (1, "gone", li(one))])
    b = world(spark, (), [(1, "p", li(one, obj, f(1.0 + 1e-12), one)), (1, "same", '{"items":[{"value":"1","type":"int"}],"type":"list"}')])
    d = lambda **k: {(r.path, r.kind) for r in valuediff.node_diffs(a, b, **k).collect()}
    assert d() == {("list:2", "type_mismatch"), ("list:3", "changed"), ("list:4", "extra")} and d(tolerant=True) == d() - {("list:3", "changed")}


def test_exports(spark, tmp_path):
    session.ship(spark)
    w = world(spark, tree((1, [])), [(1, "p", None)], [(1, "go* run", 5, ["a;", None]), (1, "none", 5, None), (1, "e/x", 5, [])])
    assert {r.name: r.text for r in export.listings(w).collect()} == {"go* run": "@program #1:go*\na;\n\n.", "e/x": "@program #1:e/x\n."}
    assert sorted(r.path for r in export.write_flat(w, str(tmp_path)).collect()) == ["1/0-go_.moo", "1/2-e_x.moo"]
    assert (tmp_path / "1" / "0-go_.moo").read_text().endswith("a;\n\n.")
    assert json.loads(export.nested_json(w).collect()[0].json)["verbs"][0]["code"] == ["a;", None]
    t = lambda rows: spark.createDataFrame(rows, "k int, t string")
    d = export.first_difference(t([(1, "a\nb"), (2, "a"), (3, "x"), (4, None)]), t([(1, "a\nc"), (2, "a\nb"), (3, "x"), (4, "y")]), ["k"], "t")
    assert {tuple(r) for r in d.collect()} == {(1, 2), (2, 2)}
    n = world(spark, tree((5, [])), (), [(5, "v", 5, ['x = 5 + 55; y = "5"; z = #5; a.5'])])
    assert n.verbs.count() == 1 and [tuple(r) for r in export.numbers_in_code(n, n.objects.select("id")).collect()] == [(5, "v", 1, 5)]


def test_code_is_renumbered_outside_strings(spark):
    session.ship(spark)
    w = world(spark, tree((1, []), (5, []), (9, [])), (), [(1, "v", 5, ['x = #5; y = "#5 \\" #9"; $#9 #99 a#5 #9.#5', None, "no"]), (1, "n", 5, None)])
    ids = rewrite.renumbering(w, w.objects.filter("id = 9").select("id"))
    got = rewrite.renumbered_code(w, ids, -100).collect()
    assert [tuple(r) for r in got] == [(1, "v", ['x = #1; y = "#5 \\" #9"; $#9 #-199 a#5 #-109.#1', None, "no"])]


def test_emptied_and_dead_entries(spark):
    w = world(spark, [(1, None, 0, 0, -1, [], [], [3, 9, 3, None]), (2, None, 0, 0, -1, [], [], None), (3, None, 0, 0, -1, [], [], [])], [(1, "P", J("string", "x")), (1, "q", CLEAR), (2, "p", J("int", "4"))])
    assert {r.id: r.contents for r in rewrite.without_dead(w, w.objects.filter("id = 3").select("id")).collect()} == {1: [9, None], 2: None, 3: []}
    assert {(r.oid, r.name): r.value_json for r in rewrite.emptied(w, 1, "p").collect()} == {(1, "P"): '{"type":"string","value":""}', (1, "q"): CLEAR, (2, "p"): J("int", "4")}


def test_policies(spark):
    w = world(spark, tree((1, []), (2, [1]), (3, [])), [(2, "Secret", None), (3, "secret_x", None), (3, "open", None)], [(2, "v", 5, None), (3, "v", 5, None)])
    rules = policy.parse({"rules": [{"name": "a", "kind": "property", "pattern": "secret*"}, {"name": "b", "kind": "verb", "oid": 1, "subtree": True}, {"name": "c", "kind": "object", "oid": 3}]})
    bound = policy.bind(spark, rules, w, world(spark))
    assert {(r.rule, r.side, r.n) for r in policy.match_counts(bound).collect()} == {("a", "old", 2), ("b", "old", 1), ("c", "old", 1)}
    ev = spark.createDataFrame([("property", 2, "Secret", "changed"), ("property", 2, "Secret", "meta"), ("property", 3, "open", "changed"), ("verb", 2, "v", "removed"), ("verb", 3, "v", "removed")], "kind string, oid bigint, name string, change string")
    assert {tuple(r) for r in policy.apply(ev, bound).collect()} == {("property", 2, "", "redacted"), ("property", 3, "open", "changed"), ("verb", 2, "", "redacted"), ("verb", 3, "v", "removed")}
    for bad in ({}, {"rules": [{"name": "x", "kind": "nothing"}]}, {"rules": [{"name": "x", "kind": "verb", "oid": "1"}]}, {"rules": [{"name": "x", "kind": "verb", "subtree": True}]}, {"rules": [{"name": "x", "kind": "verb"}] * 2}, {"rules": [{"kind": "verb", "extra": 1}]}):
        with pytest.raises(ValueError):
            policy.parse(bad)
    assert policy.bind(spark, [], w, w).count() == 0


def test_inherited_edges_and_overlays(spark):
    w = world(spark, tree((1, []), (2, [1])), [(1, "p", J("list", items=[json.loads(J("obj", "2"))])), (2, "p", CLEAR)])
    assert [tuple(r) for r in graph.effective_edges(w).collect()] == [(2, 2, "inherited", "p:list:1", 1)]
    e = graph.edges(w)
    o = spark.createDataFrame([(1, 2, "knows", "")], e.schema)
    assert graph.with_overlay(w, e, o, ("knows",)).count() == e.count() + 1
    for bad in (("other",), ):
        with pytest.raises(ValueError):
            graph.with_overlay(w, e, o, bad)


def test_history_build_resumes(spark, sf, tmp_path):
    path = str(tmp_path / "h")
    dumps = live_dumps(table(spark, sf, "moo_dumps"))
    first = history.build(spark, sf, path)
    assert first == list(zip(dumps, dumps[1:])) and history.build(spark, sf, path) == [] and history.continuous(spark, path) and history.gaps(spark, dumps, path) == []
    subprocess.run(["rm", "-r", f"{path}/pair=3"], check=True)
    assert history.gaps(spark, dumps, path) == [first[2]]
    assert history.build(spark, sf, path) == [first[2]]
    every = history.events(spark, path)
    assert sum(history.events(spark, path, k).count() for k in ("object", "property", "verb")) == every.count() > 0
    verbs = history.events(spark, path, "verb", changes=["code", "added"])
    page = history.event_page(verbs, 0, 2).collect()
    assert len(page) == 2 and page[0].total == verbs.count() > 2 and page[0].next_offset == 2
    text = {r.pair: r.text for r in history.rendered(every).collect()}
    assert sum(t.count("\n") for t in text.values()) == every.count() and text[1].startswith(f"## {dumps[0]} to {dumps[1]}\n- ")
    subprocess.run(["mv", f"{path}/pair=2", f"{path}/pair=9"], check=True)
    assert not history.continuous(spark, path)


def test_committed_dumps(spark, tmp_path):
    session.ship(spark)
    repo = str(tmp_path / "r")
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
    git = lambda *a, at="0": subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=env | {"GIT_AUTHOR_DATE": f"{at} +0000", "GIT_COMMITTER_DATE": f"{at} +0000"})
    os.makedirs(repo)
    git("init", "-q")
    d = new_dump()
    for n, at in (("one", "1000000000"), ("two", "1000000100")):
        d["objects"][1]["name"] = n
        textdump.write_split(d, f"{repo}/world")
        git("add", "-A")
        git("commit", "-qm", n, at=at)
    t = commits.load(spark, repo, "world")
    assert [r.name for r in t["object"].filter("id = 1").orderBy("at").collect()] == ["one", "two"]
    c = [x["commit"] for x in commits.chain(repo)]
    assert commits.resolve_date(repo, 1000000050) == c[0] and commits.resolve_date(repo, 5) is None and commits.resolve_date(repo, 2000000000) == c[1]


def test_live_session():
    s = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = s.accept()
        f = c.makefile("rwb")
        assert f.readline() == b"connect wiz pw\r\n"
        for _ in range(2):
            mark = f.readline().decode("latin-1").split('"')[1]
            row = '{#2, "caf\xe9 \\"x\\"", #1, #-1, #3, 1, 2, 3, 4, 1, 0}'
            f.write(f"noise\r\n{mark}\r\n{row}\r\nnot a literal\r\n{mark}\r\n".encode("latin-1"))
            f.flush()
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    x = live.Session("127.0.0.1", s.getsockname()[1])
    x.login("wiz", "pw")
    got = [json.loads(r) for r in x.census(0, 19, 10)]
    assert got[0] == {"object": 2, "name": 'caf\xe9 "x"', "owner": 1, "parent": -1, "location": 3, "n_verbs": 1, "n_properties": 2, "n_children": 3, "n_contents": 4, "fertile": True, "player": False, "seq": 1} and got[1] == {"block_first": 0, "block_last": 9} and got[3]["block_last"] == 19
    with pytest.raises((ConnectionError, OSError)):
        x.ask("1")
    x.close()


def test_command_line(spark, sf, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "p4_found" in capsys.readouterr().out
    assert cli.main(["run", "nothing", sf]) == 2
    assert cli.main(["run", "players", sf, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert cli.main(["run", "players", sf, "--limit", "1"]) == 0


def test_shown_values_and_resolution(spark):
    from worldloom.operators import inherit

    props = [(0, "Lib", J("obj", "1")), (1, "sub", J("obj", "2")), (2, "sub", CLEAR), (2, "lost", CLEAR), (0, "word", J("string", "x"))]
    w = world(spark, tree((0, []), (1, []), (2, [1])), props)
    assert {(r.oid, r.name): r.value_from for r in inherit.all_values(w).collect()}[2, "sub"] == 1
    refs = spark.createDataFrame([(x,) for x in ("#2", "1", "$lib", "$LIB.sub", "$lib.sub.sub", "$word", "$none", "#77", "bad", "$lib.none")], "ref string")
    assert {r.ref: r.id for r in inherit.resolve(w, refs).collect()} == {"#2": 2, "1": 1, "$lib": 1, "$LIB.sub": 2, "$lib.sub.sub": 2, "$word": None, "$none": None, "#77": None, "bad": None, "$lib.none": None}


def test_string_mentions_and_choices(spark):
    w = world(spark, [(1, "Amber", 0, 7, 5, [], [], []), (2, None, 0, None, -1, [9], [], [])], [(1, "p", J("string", "see #2, #22 and #2"))])
    assert [tuple(r) for r in inspect.string_mentions(w).collect()] == [(2, 1, "p", 2)]
    assert {r.id for r in inspect.chosen(w, [2], 7).collect()} == {1, 2} and {r.id for r in inspect.chosen(w, name_pattern="^Am").collect()} == {1}
    assert {r.number: r.n_missing for r in inspect.missing_by(w, "number").collect()} == {5: 1, 7: 1, 9: 1}


def test_dump_files(spark, tmp_path):
    session.ship(spark)
    (tmp_path / "d").mkdir()
    data = textdump.render(new_dump())
    (tmp_path / "d" / "a.db").write_bytes(data)
    (tmp_path / "d" / "b.db").write_bytes(data[:-1])
    assert {r.dump: (r.same, r.first_line) for r in textdump.round_trips(spark, str(tmp_path / "d")).collect()}["a.db"] == (True, None)
    p = {r.dump: r.size for r in textdump.provenance(spark, str(tmp_path / "d")).collect()}
    assert p == {"a.db": len(data), "b.db": len(data) - 1}
    one = textdump.open_cached(spark, str(tmp_path / "d"), str(tmp_path / "c"))
    assert one["object"].count() == 10 and textdump.open_cached(spark, str(tmp_path / "d"), str(tmp_path / "c"))["verb"].count() == 4


def test_scratch_is_cleared(spark):
    df = session.materialize(spark.range(5), "x")
    path = df.inputFiles()[0]
    assert session.count_rows(df) == 5 and session.clear_scratch(spark) >= 1
    assert not os.path.exists(path.replace("file://", "").replace("file:", ""))
    assert session.clear_scratch(spark) == 0


def test_list_edits(spark):
    session.ship(spark)
    li = lambda *x: {"type": "list", "items": list(x)}
    n = lambda *x: li(*[json.loads(J("int", str(i))) for i in x])
    old = world(spark, (), [(1, "p", json.dumps(n(1, 2, 3))), (1, "q", json.dumps(li(n(1), n(5, 6)))), (1, "r", json.dumps(n(1))), (1, "e", json.dumps(n()))])
    new = world(spark, (), [(1, "p", json.dumps(n(1, 9, 2, 3))), (1, "q", json.dumps(li(n(1, 2), n(6)))), (1, "r", json.dumps(n(2))), (1, "e", json.dumps(n(4)))])
    got = {tuple(r) for r in valuediff.list_edits(old, new).collect()}
    assert got == {(1, "p", "", "insert", 1, 1, 1, 2), (1, "q", "list:1", "insert", 1, 1, 1, 2), (1, "q", "list:2", "delete", 0, 1, 0, 0), (1, "e", "", "insert", 0, 0, 0, 1)}


def test_policies_are_read_strictly():
    text = '{"rules": [{"name": "a", "kind": "verb"}, {"kind": "object", "name": "b", "oid": 3}]}'
    other = '{"rules": [{"oid": 3, "name": "b", "kind": "object"}, {"name": "a", "kind": "verb"}]}'
    assert policy.digest(policy.load(text)) == policy.digest(policy.load(other)) != policy.digest(policy.load(text)[:1])
    for bad in ('{"rules": [], "rules": []}', '{"rules": [{"name": "a", "kind": "verb", "oid": NaN}]}', "[]", '{"rules": [{"name": "a", "name": "a", "kind": "verb"}]}'):
        with pytest.raises(ValueError):
            policy.load(bad)
