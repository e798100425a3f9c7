import random
import re

import numpy as np
import pytest

from worldloom.llm import leak
from worldloom.llm.words import words_of

DOC = "doc_id bigint, text string, item_id int, n_words int"
ITEM = "item_id int, text string, doc_id int"


def grams(text, n):
    w = re.findall("[a-z0-9]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def longest(a, b):
    a, b = (re.findall("[a-z0-9]+", x.lower()) for x in (a, b))
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "C", "d1", "e", "É", "x-y"])
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 30))), 9) for i in range(25)]
    docs = [(i, r.choice([" ", "\n+ ", "--"]).join(word() for _ in range(r.randrange(40))), 1, 1) for i in range(60)]
    docs += [(100 + i, "intro " + re.sub(" ", "\n# ", items[i % 25][1].upper()) + " outro", 1, 1) for i in range(40)]
    docs += [(900, None, 1, 1), (901, "", 1, 1), (100, docs[60][1], 1, 1), (None, docs[61][1], 1, 1)]
    d, q = spark.createDataFrame(docs, DOC), spark.createDataFrame([*items, (70, None, 0), (None, "x", 0), items[0]], ITEM)
    want = {(i, j) for i, t, *_ in docs for j, s, _ in items if grams(t, 6) & grams(s, 6)}
    for how in ({}, {"block_chars": 60, "shard_bytes": 50}):
        found = leak.find_leaks(d, q, min_words=6, **how)
        assert {tuple(x) for x in leak.leaked_pairs(found).collect()} == want
    top = {(x.doc_id, x.item_id): x.n_words for x in found.groupBy("doc_id", "item_id").agg({"n_words": "max"}).withColumnRenamed("max(n_words)", "n_words").collect()}
    text, item = {i: t for i, t, *_ in docs}, {i: t for i, t, _ in items}
    some = sorted(k for k in top if k[0] is not None)[:15]
    assert {k: top[k] for k in some} == {k: longest(text[k[0]], item[k[1]]) for k in some}


def test_suffix_array_orders_suffixes():
    r = random.Random(3)
    seq = np.array([r.randrange(3) for _ in range(200)])
    sa = leak.suffix_array(seq, 16)
    keys = [tuple(seq[i : i + 16]) for i in sa]
    assert sorted(sa) == list(range(200)) and keys == sorted(keys)


def test_words_fold_case_and_split_everywhere_else():
    w = words_of(["Foo_bar\r\n+baz9 É", None, "FOO"])
    assert w.text.tolist() == [0, 0, 0, 2] and w.hash[0] == w.hash[3] and w.length.tolist() == [3, 3, 4, 3]


def test_empty_tables_and_clean_corpus(spark):
    d, q = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    full = spark.createDataFrame([(1, "a b c d e f", 1, 1), (None, "a b c d e f", 1, 1), (2, "z", 1, 1)], DOC)
    item = spark.createDataFrame([(1, "a b c d e f", 0)], ITEM)
    assert leak.find_leaks(d, item).collect() == [] and leak.find_leaks(full, q).collect() == []
    found = leak.find_leaks(full, item, min_words=6)
    assert sorted(str(x.doc_id) for x in leak.without_leaks(full, found).collect()) == ["2", "None"]
    assert [tuple(x) for x in leak.item_report(found.filter("doc_id = 1")).collect()] == [(1, 1, 6)]
