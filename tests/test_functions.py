import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worldloom import session
from worldloom.functions import literals as L
from worldloom.functions import moo
from worldloom.functions.values import canonical, code_hash, value_hash

SCALARS = st.one_of(
    st.integers(-(2**70), 2**70).map(lambda n: {"type": "int", "value": str(n)}), st.integers(-5, 10**6).map(lambda n: {"type": "obj", "value": str(n)}), st.text(max_size=12).map(lambda s: {"type": "string", "value": s}), st.integers(0, 18).map(lambda n: {"type": "error", "value": str(n)}),
    st.booleans().map(lambda b: {"type": "bool", "value": b}), st.sampled_from([0.5, -2.0, 1e300, 1234567.0]).map(lambda x: {"type": "float", "bits": __import__("struct").pack(">d", x).hex()}),
)
VALUES = st.recursive(SCALARS, lambda v: st.one_of(st.lists(v, max_size=3).map(lambda x: {"type": "list", "items": x}), st.lists(st.tuples(SCALARS, v), max_size=3).map(lambda x: {"type": "map", "entries": [{"key": k, "value": y} for k, y in x]})), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_literals_round_trip(v):
    assert L.parse(L.render(v)) == v


@pytest.mark.parametrize("text", ["", "{1,}", "{1", "[1 -> ]", "[1]", "nonsense", "1 2", '"open', "{,}", "->"])
def test_bad_literals(text):
    with pytest.raises(L.LiteralError):
        L.parse(text)


def test_literal_columns(spark):
    session.ship(spark)
    df = spark.createDataFrame([('{"type":"list","items":[{"type":"obj","value":"5"},{"type":"string","value":"a\\"b"}]}',), ("no",), (None,)], "v string")
    assert [r[0] for r in df.select(L.literal_of("v")).collect()] == ['{#5, "a\\"b"}', None, None]
    assert [r[0] for r in df.select(L.literal_of("v", 6)).collect()] == ["{#5...", None, None]
    back = df.select(L.value_of(L.literal_of("v")).alias("x")).collect()
    assert json.loads(back[0].x)["items"][0] == {"type": "obj", "value": "5"} and back[1].x is None


@pytest.mark.parametrize(
    ("alias", "word", "yes"),
    [("pol*ish", "pol", True), ("pol*ish", "polis", True), ("pol*ish", "po", False), ("pol*ish", "polishes", False), ("gr*", "grindstone", True), ("gr*", "g", False), ("*", "xyzzy", True), ("hum", "HUM", True), ("hum", "hu", False), ("s*t*ir", "st", True), ("s*t*ir", "stx", False), ("ö*", "Ö", False)],
)
def test_verb_names(spark, alias, word, yes):
    assert spark.createDataFrame([(alias, word)], "a string, w string").select(moo.answers("a", "w")).collect()[0][0] is yes


def test_masking(spark):
    codes = [
        ['x = "a \\" b" + y;', 'open "never', "closed #5", '" shut #6', "", '""'],
        ['"ends in a stroke \\', 'here" + #7', None, "'no string'"],
        [],
        None,
        ['"'],
    ]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in codes], "c array<string>").select(moo.masked("c")).collect()]
    assert got == [["x =          + y;", "open       ", "         ", "  shut #6", "", "  "], [" " * 19, "      + #7", "", "'no string'"], [], None, [" "]]
    assert all(len(a or "") == len(b) for x, y in zip(codes, got) for a, b in zip(x or [], y or []))


def test_small_ones(spark):
    df = spark.createDataFrame([(1058, 26, 7, -5, 1700000000, "100%25+A"), (None, None, None, None, 0, None)], "f int, p int, q int, n bigint, s bigint, u string")
    r = df.select(moo.flag_words("f"), moo.letters("p", moo.VERB_PERMS), moo.verb_args("p", "q"), moo.low32("n"), moo.clock("s"), moo.catalog_key("u")).collect()
    assert tuple(r[0]) == ("programmer writable recycled", "wd", "any through none", 4294967291, "2023-11-14 22:13:20", "100%+a") and r[1][0] == "-" and r[1][3] is None and r[1][4] is None
    assert re.search(moo.reference_pattern(5), "a #5;") and not re.search(moo.reference_pattern(5), "#55 $#5 x#5")
    assert re.search(moo.glob("a*[bc]?"), "axxbz") and not re.search(moo.glob("a*"), "ba")


def test_canonical_values(spark):
    same = ['{"type":"string","value":"é/"}', '{\n "value": "\\u00e9\\/",\n "type": "string" }']
    df = spark.createDataFrame([(x,) for x in [*same, '{"type":"string","value":"e/"}', None, "no json", '{"type":"int","value":"1"}', '{"type":"obj","value":"1"}']], "v string")
    r = df.select(canonical("v").alias("c"), value_hash("v").alias("h")).collect()
    assert r[0].c == r[1].c and r[0].h == r[1].h and len({x.c for x in r}) == 6 and r[3].h is None
    c = spark.createDataFrame([(None,), ([],), ([""],), ([None],), (["a", "b"],), (["ab"],)], "c array<string>")
    h = [x[0] for x in c.select(code_hash("c")).collect()]
    assert h[0] is None and len(set(map(str, h))) == 6


def test_truth(spark):
    rows = [("int", "0", 0, False), ("int", "1", 0, True), ("float", "0" * 16, 0, False), ("float", "8" + "0" * 15, 0, False), ("string", "", 0, False), ("string", "x", 0, True), ("list", None, 0, False), ("list", None, 1, True), ("map", None, 0, False), ("obj", "5", 0, False), ("error", "1", 0, False), (None, None, None, False)]
    df = spark.createDataFrame(rows, "t string, s string, n int, want boolean")
    assert df.filter(moo.truth("t", "s", "n") != F.col("want")).collect() == []
