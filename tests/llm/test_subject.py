import random

import numpy as np

from worldloom.llm import subject as S
from worldloom.session import materialize

DOC = "doc_id bigint, text string, subject string, kind int"
WORDS = {"law": "tort clause bailiff verdict statute appeal".split(), "music": "sonata choir oboe cadence fugue legato".split(), "sport": "wicket league striker podium relay slalom".split()}


def corpus(n, seed):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        subj = r.sample(sorted(WORDS), r.choice([1, 1, 1, 2]))
        files = "".join(f"diff --git a/x{k} b/x{k}\n@@ -1 +1 @@\n" + "".join(f"+return this {r.choice(WORDS[s])} none {r.choice(WORDS[s])}\n" for _ in range(4)) for k, s in enumerate(subj))
        rows.append((i, f"commit ab12\nAuthor: Verdict Sonata\n\n    update\n\n{files}", "x", 1))
        truth[i] = set(subj)
    rows += [(n, "commit 1\nMerge: 1 2\n\n    Merge branch 'tort'\n", "x", 1), (n + 1, None, "x", 1), (n + 2, "", "x", 1), (n + 3, "commit 1\n\n    bump\n\ndiff --git a/package.lock b/package.lock\n+wicket\n", "x", 1)]
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus(500, 1)
    labels = [(i, s) for i in list(truth)[:80] for s in truth[i]] + [(0, "no such subject"), (3, None), (99999, "law")]
    labels += [(i, "sport") for i in range(80, 84)]  # wrong ones
    df = spark.createDataFrame(rows, DOC)
    seg = materialize(S.segments(df), "t")
    m = S.fit(seg, spark.createDataFrame([(s, w[0]) for s, w in WORDS.items()] + [("law", "twice"), (None, "x")], "subject string, about string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), rank=5)
    got = {}
    for r in S.assign(seg, m).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i >= 84]
    assert np.mean([got.get(i, set()) == truth[i] for i in held]) > 0.95
    assert not set(got) & {500, 501, 502, 503}


def test_cut_drops_furniture():
    seg = S.cut("From ab Mon\nSubject: [PATCH] tune the choir\n\nFixes #1\n---\n a.py | 2 +-\ndiff --git a/v b/vendor/x.c\n+junk\ndiff --git a/a b/a\nindex 1..2\n+oboe\n-fugue\n")
    assert seg == [(0, "tune the choir"), (2, "+oboe\n-fugue\n")]
    assert S.cut("") == []


def test_empty_corpus(spark):
    seg = materialize(S.segments(spark.createDataFrame([], DOC)), "e")
    m = S.fit(seg, spark.createDataFrame([("law", None)], "subject string, about string"), spark.createDataFrame([], "doc_id bigint, subject string"), rank=2)
    assert S.assign(seg, m).collect() == []


def test_message_counts_where_only_furniture_changed():
    binary = "commit 1\n\n    Add recording of the second sonata\n\ndiff --git a/s.ogg b/s.ogg\nnew file mode 100644\nBinary files /dev/null and b/s.ogg differ\n"
    rename = "commit 1\n\n    Move the choir\n\ndiff --git a/x b/y\nsimilarity index 100%\nrename from x\nrename to y"
    assert S.cut(binary) == [(0, "Add recording of the second sonata")]
    assert S.cut(rename) == [(0, "Move the choir")]
    assert S.cut("commit 1\n\ndiff --git a/yarn.lock b/yarn.lock\n+sonata") == []
