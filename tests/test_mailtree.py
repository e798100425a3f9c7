import json

from test_operators import J, world

from worldloom.operators import mailtree

S = lambda x: json.loads(J("string", x))
N = lambda x: json.loads(J("int", str(x)))
L = lambda *x: {"type": "list", "items": list(x)}


def leaf(n, body=None):
    return L(S(body) if body else N(0), N(n), N(1000 + n), S("A (#1)"), S("*B (#2)"), S(f"subject {n}"))


def test_trees(spark):
    props = {
        "messages": L(S("top"), N(3), L()),
        "top": L(N(1), L(L(S("a"), N(2), L()), L(S("b"), N(5), L()), L(S("gone"), N(0), L()))),
        "a": L(N(0), L(leaf(1, "body1"), leaf(2))),
        "b": L(N(0), L(leaf(7), L(N(0), N(8)))),
        "body1": L(S("text"), S("more")),
        "other": L(N(0), S("no list")),
    }
    w = world(spark, (), [(7, n, json.dumps(v)) for n, v in props.items()] + [(8, "top", json.dumps(L(N(2), L(L(S("top"), N(1), L()))))), (9, "x", None)])
    got = {(r.member, r.entry): (r.number, r.date, r.subject, r.body_property) for r in mailtree.messages(w).collect()}
    assert got == {("a", 1): (1, 1001, "subject 1", "body1"), ("a", 2): (2, 1002, "subject 2", None), ("b", 1): (7, 1007, "subject 7", None)}
    assert {(r.child, r.declared) for r in mailtree.descriptors(w).filter("oid = 7").collect()} == {("a", 2), ("b", 5), ("gone", 0)}
    assert {(r.oid, r.child, r.problem) for r in mailtree.broken(w).collect()} == {(7, "b", "count"), (7, "gone", "missing"), (8, "top", "level")}
    assert mailtree.messages(world(spark)).collect() == []
