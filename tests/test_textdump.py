import json

import pytest

from worldloom.sources import textdump as T

V = lambda t, v=None, **k: {"type": t, **({"value": v} if v is not None else {}), **k}
LIST = lambda *x: V("list", items=list(x))
OBJS = lambda *n: LIST(*[V("obj", str(i)) for i in n])


def thing(i, parents, names=(), values=(), verbs=(), **k):
    return {
        "id": i, "recycled": False, "name": k.get("name", f"thing {i}"), "flags": 16, "owner": 2, "location": V("obj", "-1"), "last_move": V("int", "0"), "contents": OBJS(), "parents": parents, "children": OBJS(),
        "verbs": [{"name": n, "owner": 2, "perms": 173, "preps": -1} for n in verbs], "slots": {"names": list(names), "values": [{"value": v, "owner": 2, "perms": 5} for v in values]},
    }


def call(new=True):
    c = {"temp": V("int", "0"), "this": V("obj", "1"), "vloc": V("obj", "1"), "threaded": 1, "numbers": [1, -7, -8, 2, -9, 2, 1, -10, 1], "argstr": "", "dobjstr": "", "prepstr": "", "iobjstr": "", "verb": "go", "verbname": "go"}
    return c if new else {**c, "this": None, "vloc": None, "threaded": 0}


def frame(name=None, new=True):
    state = {None: None, "move": ["move", "x 1"], "call_function": ["call_function", T.CALL_FUNCTION + "create", "y"], "eval": ["eval"]}[name]
    return {"language": f"language version {17 if new else 4}", "code": ["return 1;"], "env": [{"name": "NUM", "value": V("int", "0")}], "stack": [LIST()], "call": call(new), "end": V("none"), "pc": [3, 1 if name else 0, 0], "builtin": state}


def new_dump(end="\n"):
    waif = V("waif", "0")
    everything = LIST(
        V("int", "123456789012345678901234567890"), V("string", 'caf\xe9 "q" \r bare'), V("error", "3"), V("clear"), V("none"), V("catch", "1"), V("finally", "2"), V("float", bits="8000000000000000"), V("float", bits="3fb999999999999a"), V("anon", "-1"), V("bool", True), waif,
        V("map", entries=[{"key": V("int", "1"), "value": waif}, {"key": V("obj", "1"), "value": V("string", "")}, {"key": V("string", "A"), "value": V("map", entries=[])}]),
    )
    return {
        "version": 17, "server": "AnyMOO", "line_end": end, "players": [2, 3], "pending": [V("int", "1")], "clocks": ["c 1"],
        "queued": [{"head": [0, 1, 100, 7], "call": call(), "env": [{"name": "a", "value": V("int", "5")}], "code": ["x;", ""]}],
        "suspended": [{"start": 5, "id": 8, "value": V("string", "hi"), "vm": {"local": V("map", entries=[]), "head": [1, -1, 0, 50], "frames": [frame("move"), frame("call_function")]}}, {"start": 5, "id": 9, "value": None, "vm": {"local": LIST(), "head": [0, -1, 0, 50], "frames": [frame()]}}],
        "interrupted": [{"id": 4, "status": "interrupted reading", "vm": {"local": LIST(), "head": [0, -1, 0, 50], "frames": [frame("eval")]}}],
        "connections": {"listeners": " with listeners", "lines": ["1 2"]},
        "objects": [
            thing(0, V("obj", "-1"), ["root"], [V("obj", "1")], ["do_login*_command", "x"]), thing(1, OBJS(), ["a1"], [everything]), thing(2, OBJS(1), ["b1"], [V("int", "1"), V("clear")]),
            {"id": 3, "recycled": True}, thing(4, OBJS(1, 2), ["c1"], [V("int", "9"), V("clear"), V("string", "mine")]),
        ],
        "anonymous": [[thing(3, OBJS(1), (), [V("clear")])]],
        "programs": [{"oid": 0, "verb_index": 1, "code": []}, {"oid": 0, "verb_index": 0, "code": ["return;", "", ". "]}],
        "waifs": {0: {"waif_class": 1, "owner": 2, "propdefs_length": 3, "slots": [[0, V("int", "1")], [5, waif]]}},
    }


def old_dump(connections):
    def obj(i, parent):
        n = thing(i, None, ["p"], [V("int", "1")], ["v"])
        return {k: n[k] for k in ("id", "recycled", "name", "flags", "owner", "verbs", "slots")} | {"blank": "", "location": -1, "first_content": -1, "neighbour": -1, "parent": parent, "first_child": -1, "sibling": -1}

    return {
        "version": 4, "server": "AnyMOO", "line_end": "\n", "n_objects": 3, "n_programs": 1, "dummy": "0", "players": [1], "objects": [obj(0, -1), {"id": 1, "recycled": True}, obj(2, 0)], "programs": [{"oid": 2, "verb_index": 0, "code": ["a"]}], "clocks": [], "queued": [],
        "suspended": [{"start": 1, "id": 2, "value": None, "vm": {"local": None, "head": [0, -1, 0, 50], "frames": [frame(new=False)]}}], "connections": connections, "waifs": {},
    }


@pytest.mark.parametrize("dump", [new_dump(), new_dump("\r\n"), old_dump(None), old_dump({"listeners": "", "lines": ["x"]})])
def test_round_trip(dump):
    data = T.render(dump)
    assert T.parse(data) == dump and T.render(T.parse(data)) == data


def test_waifs_are_renumbered_by_first_writing():
    d = new_dump()
    d["waifs"] = {7: d["waifs"][0]}
    text = json.dumps(d).replace('"waif", "value": "0"', '"waif", "value": "7"')
    d = json.loads(text) | {"waifs": {7: json.loads(text)["waifs"]["7"]}}
    assert T.render(d) == T.render(new_dump())


@pytest.mark.parametrize("cut", range(1, 200, 7))
def test_truncation_is_an_error(cut):
    lines = T.render(new_dump()).split(b"\n")
    with pytest.raises(T.DumpError):
        T.parse(b"\n".join(lines[: -1 - cut]))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"Version 17", b"Version 9"), (b"Version 17", b"Version x"), (b"#1\n", b"#0\n"), (b"2\n2\n3\n", b"-2\n2\n3\n"), (b"\nc 0\n", b"\nz 0\n"), (b"#0:0\n", b"#0:1\n"), (b"\n10\n3\n0\n1\n", b"\n10\n3\n0\nx\n"), (b"\n2\nA\n", b"\n0\n1\n"), (b"1 clocks", b"one clocks"), (b"3 1 0\nmove", b"3 1\nmove"), (b"\n14\n1\n", b"\n11\n1\n")],
)
def test_broken_dumps(old, new):
    data = T.render(new_dump())
    assert old in data
    with pytest.raises(T.DumpError):
        T.parse(data.replace(old, new, 1))


def test_map_keys_follow_the_server():
    assert T.map_key(V("string", "AB\xc9")) == ("string", "ab\xc9") and T.map_key(V("int", str(2**32 + 1))) == ("int", 1) and T.map_key(V("int", str(2**70))) is None
    assert T.map_key(V("float", bits="8000000000000000")) == T.map_key(V("float", bits="0" * 16)) and T.map_key(V("float", bits="7ff8000000000000")) is None
    assert T.map_key(LIST()) is None and T.map_key(V("obj", "1")) != T.map_key(V("int", "1"))


def test_slots_are_named_by_ancestry():
    names = {(r["oid"], r["slot"]): (r["definer"], r["name"]) for s, _, r in T.rows(new_dump()) if s == "property"}
    assert [names[4, i] for i in range(3)] == [(4, "c1"), (1, "a1"), (2, "b1")] and names[2, 1] == (1, "a1")


def test_split_and_join(tmp_path):
    d, folder = new_dump(), str(tmp_path / "parts")
    first = T.write_split(d, folder)
    assert T.join_split(folder) == T.render(d) and T.write_split(d, folder) == [] and "objects/1.moo" in first
    d["objects"][1]["name"] = "renamed"
    d["objects"][4] = {"id": 4, "recycled": True}
    assert set(T.write_split(d, folder)) == {"objects/1.moo", "objects/4.moo"} and T.join_split(folder) == T.render(d)
    (tmp_path / "parts/objects/1.moo").write_bytes(b"x")
    with pytest.raises(T.DumpError):
        T.join_split(folder)


def test_load_as_tables(spark, tmp_path):
    from worldloom import session

    session.ship(spark)
    for n, d in (("a.db", new_dump()), ("b.db", old_dump(None))):
        (tmp_path / n).write_bytes(T.render(d))
    t = T.load(spark, str(tmp_path))
    assert t["object"].groupBy("dump").count().orderBy("dump").collect() == [("a.db", 5), ("b.db", 2)]
    assert sorted(r.code is None for r in t["verb"].filter("dump = 'a.db'").collect()) == [False, False] and t["waif"].count() == 1
    assert {r.name for r in t["variable"].collect()} == {"a", "NUM"} and t["task"].count() == 5 and t["frame"].count() == 6
    assert t["object"].filter("anon").select("id").collect() == [(3,)] and t["recycled"].count() == 2
