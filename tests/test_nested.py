import json
import random

import pyarrow as pa
import pytest

from worldloom.operators import nested


def walk(v, path=""):
    step = lambda s: f"{path}/{s}" if path else s
    if v["type"] == "list":
        for i, x in enumerate(v["items"], 1):
            yield step(f"list:{i}"), x["type"], path
            yield from walk(x, step(f"list:{i}"))
    if v["type"] == "map":
        for i, e in enumerate(v["entries"], 1):
            for k in ("key", "value"):
                yield step(f"map:{i}:{k}"), e[k]["type"], path
                yield from walk(e[k], step(f"map:{i}:{k}"))


def value(r, depth):
    if depth and r.random() < 0.6:
        if r.random() < 0.5:
            return {"type": "list", "items": [value(r, depth - 1) for _ in range(r.randrange(4))]}
        return {"type": "map", "entries": [{"key": value(r, 0), "value": value(r, depth - 1)} for _ in range(r.randrange(4))]}
    return r.choice([{"type": "int", "value": "5"}, {"type": "string", "value": r.choice(['"[{', "\\", 'a\\"],', "é 木", '{"type":"int"}', ""])}, {"type": "clear"}, {"type": "bool", "value": True}, {"type": "float", "bits": "0" * 16}])


def spell(r, v):
    if isinstance(v, dict):
        v = dict(sorted(v.items(), key=lambda _: r.random()))
        v = {k: json.loads(spell(r, x)) for k, x in v.items()}
    return json.dumps(v, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5, separators=r.choice([(",", ":"), (" , ", " : ")]))


def flat(texts, top="value", linked=False, **how):
    """All pieces as lists: text numbers, slots, paths, tags, parent paths, scalars."""
    out = [[], [], [], [], [], []]
    for row, slot, path, tag, extra in nested.flatten_batch(pa.array(texts, pa.string()), top, linked, **how):
        cols = [row.tolist(), slot.to_pylist(), path.to_pylist(), tag.to_pylist()] + ([extra["parent"].to_pylist(), extra["value"].to_pylist()] if linked else [[], []])
        out = [a + b for a, b in zip(out, cols)]
    return out


@pytest.mark.parametrize("piece", [64_000_000, 50])
@pytest.mark.parametrize("seed", range(4))
def test_values_against_recursion(seed, piece):
    r = random.Random(seed)
    vs = [value(r, 5) for _ in range(60)]
    texts = [spell(r, v) for v in vs]
    bad = ['{"type":"list","items":[{"type":"int"', None, "", "[1,2", '{"a"}', "}", '"', '{"type":"list","items":[]}]', "\\", texts[0] + "x"]
    mixed = [t for pair in zip(texts, bad * 6) for t in pair]
    row, _, path, tag, parent, _ = flat(mixed, linked=True, piece_bytes=piece)
    got = sorted(zip(row, path, tag, parent))
    assert got == sorted((2 * i, *n) for i, v in enumerate(vs) for n in walk(v))


def test_slots_and_scalars():
    text = json.dumps([[4, {"type": "list", "items": [{"type": "string", "value": "a\"b"}, {"type": "float", "bits": "3ff0000000000000"}]}], [20, {"type": "int", "value": "1"}], ["x", {"type": "list", "items": [{"type": "clear"}]}]])
    _, slot, path, tag, _, content = flat([text, "[]", "[[1]]"], "slots", True)
    assert list(zip(slot, path, tag, content)) == [("4", "list:1", "string", 'a"b'), ("4", "list:2", "float", "3ff0000000000000"), ("x", "list:1", "clear", None)]


def test_escaped_field_names():
    got = flat(['{"\\u0074ype":"list","it\\u0065ms":[{"type":"int","value":"1"}]}'])
    assert got[2:4] == [["list:1"], ["int"]]


def test_long_and_empty_batches(spark):
    df = spark.createDataFrame([("property", 1, "big", json.dumps({"type": "list", "items": [{"type": "int", "value": "1"}] * 20_000})), ("property", None, None, None), ("property", 2, "s", '{"type":"int","value":"1"}')], "holder_kind string, holder_id bigint, member string, text string")
    assert nested.flatten_values(df, chunk_bytes=1000).count() == 20_000
    assert nested.flatten_values(df.limit(0)).columns == ["holder_kind", "holder_id", "member", "path", "tag"]
    assert nested.flatten_values(df.limit(0)).count() == 0


def whole(texts):
    return (~nested.Index(*nested.one_buffer(pa.array(texts, pa.string()))).bad).tolist()


def test_values_deeper_than_the_decoder():
    depth = 60_000
    with pytest.raises(RecursionError):
        json.loads("[" * depth + "]" * depth)
    deep = "[" * depth + '{"type":"int"}' + "]" * depth
    assert whole([deep, deep[:-1], deep + "]", deep.replace("int", "\\x")]) == [True, False, False, False]


def test_deep_values_have_all_rows():
    depth = 12_000
    text = '{"type":"list","items":[' * depth + "]}" * depth
    n = 0
    for row, _, path, tag, _ in nested.flatten_batch(pa.array([text, text + "]"]), "value", piece_bytes=30_000_000):
        assert set(row.tolist()) == {0} and set(tag.to_pylist()) == {"list"}
        assert path[0].as_py() == "/".join(["list:1"] * (n + 1)) and path[len(row) - 1].as_py().count("/") == n + len(row) - 1
        n += len(row)
    assert n == depth - 1


@pytest.mark.parametrize("seed", range(3))
def test_grammar_against_the_decoder(seed):
    r = random.Random(seed)
    texts = [spell(r, value(r, 4)) for _ in range(40)] + ["[]", "{}", "[1,]", "{,}", '{"a":1,}', "1 2", "", " ", "01", "-", "[1.5e-3,NaN,-Infinity]", '"\\x"', '"a\nb"', "nulll", "[null}", '{"a" "b"}', "{1:2}", "tru", "\u0661", '"\\u12"', '"\\ud8', "[:1]", '["a":1]', '{"a":}', "[,1]", '{"a":1 "b":2}', '[1"a"]', "1,2", '"a":1', "[]{}"]
    cuts = [cut for t in texts for cut in (t, t[: r.randrange(len(t) + 1)], t.replace(r.choice(t or "x"), r.choice(',:[]{}" '), 1))]

    def decodes(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False

    assert dict(zip(cuts, whole(cuts))) == {t: decodes(t) for t in cuts}


@pytest.mark.parametrize("seed", range(2))
def test_spellings_agree_exactly_where_values_do(seed):
    r = random.Random(seed)
    vs = [value(r, 5) for _ in range(60)] + [{"type": "list", "items": x} for x in ([1, 2], [2, 1], [[1], 2], [[1, 2]], [], ["1", 2], [{"a": 1}], [{"a": 1, "b": 1}])]
    one, two = (nested.spellings(pa.array([spell(r, v) for v in vs])).to_pylist() for _ in range(2))
    assert one == two
    key = [json.dumps(v, sort_keys=True) for v in vs]
    assert len(set(one)) == len(set(key)) == len(set(zip(one, key)))
    assert nested.spellings(pa.array([None, "{", "", "[1"], pa.string())).to_pylist() == [None, "!{", "!", "![1"]


def test_deep_values_compare_by_content(spark):
    from worldloom.functions.values import canonical, value_hash

    def deep(n, x, space=""):
        return f'{{{space}"type":{space}"list","items":[' * n + x + "]}" * n

    rows = [(n, same, deep(n, '{"type":"int","value":1}'), deep(n, f'{{ "value":{1 if same else 2}, "type" : "int" }}', " ")) for n in (150, 260, 700, 20_000) for same in (True, False)]
    df = spark.createDataFrame(rows, "n int, same boolean, a string, b string")
    got = df.select("n", "same", (canonical("a") == canonical("b")).alias("text"), (value_hash("a") == value_hash("b")).alias("hash")).collect()
    assert all(r.same == r.text == r.hash for r in got)
