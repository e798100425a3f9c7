import random

import numpy as np
import pandas as pd
import pytest

from worldloom.llm import pii

MAIL = "message_id bigint, sender string, recipients string, body array<string>, field string, line_no int"
BODY = [
    "Write to ann.lee (at) oxbow.test or ring +1 418 555 0140; Larkhollow, Tamsin will know.", "> The form for Tamsin", "> Larkhollow lists QQ055683D and (305)", "> 555-0160, which looks wrong.", "We moved to Flat 27, 39 Harrow Crescent, Tidewrack last week.", "Object numbers run up to #555-0157.",
    "Old Mill Lane is now a room with 12 exits.", "Granite Golem and Paper Dragon refuse.", "Ticket 2026-01342 took 181 minutes on 2026-02-15 at 08:04:18.", "see P.O. Box 4, Oxbow, and ROHAN35@OXBOW.TEST", "Dr Larkhollow | Warden", None, "",
]


@pytest.fixture(scope="module")
def mails(spark):
    names = ["Tamsin Larkhollow", "Ivo Estervane", "Rohan Ivelstone", "Greta Skarnvik"]
    rows = [(i, f"{names[i % 4]} (#{i})", f"*List (#1), \"{names[(i + 1) % 4]}\" <a{i}@x.test>", BODY, "x", 1) for i in range(40)]
    rows += [(100, "Rook_77 (#3)", None, None, "x", 1), (101, None, "", [], "x", 1), (0, *rows[0][1:])]
    return spark.createDataFrame(rows, MAIL)


@pytest.fixture(scope="module")
def model(mails):
    return pii.fit(mails)


def test_found_lines(mails, model):
    got = {(r.field, r.line_no, r.pii_type) for r in pii.find(mails, model).filter("message_id = 4").collect()}
    assert got == {
        ("sender", 0, "name"), ("recipients", 0, "name"), ("recipients", 0, "email"), ("body", 1, "email"), ("body", 1, "phone"), ("body", 1, "name"), ("body", 2, "name"), ("body", 3, "name"), ("body", 3, "id_number"), ("body", 3, "phone"), ("body", 4, "phone"),
        ("body", 5, "address"), ("body", 10, "address"), ("body", 10, "email"), ("body", 11, "name"),
    }


def test_repeated_rows_and_handles(mails, model):
    rows = pii.find(mails, model).collect()
    assert len(rows) == len(set(rows)) and not [r for r in rows if r.message_id in (100, 101)]


def test_redaction_keeps_the_rest(mails, model):
    r = pii.redact(mails, model).filter("message_id = 4").collect()[0]
    assert r.sender == "[NAME] (#4)" and r.recipients == '*List (#1), "[NAME]" <[EMAIL]>'
    assert r.body[0] == "Write to [EMAIL] or ring [PHONE]; [NAME] will know." and r.body[1] == "> The form for [NAME]" and r.body[4] == "We moved to [ADDRESS] last week."
    assert r.body[5:9] == BODY[5:9] and r.body[11] is None and r.body[12] == ""


def flat_of(model, *lines):
    return pii.flatten([(None, None, list(lines))], pii.Vocabulary(model.lexicon))


def test_marginals_equal_enumeration_on_a_tree(model):
    """Without skips the chains are exact: compare with summing over all labellings."""
    flat = flat_of(model, "ab Cd 12")
    flat.skips = flat.skips[:0]
    u = pii._scores(flat, model).astype(float)
    want = np.zeros((3, pii.N))
    for a in range(pii.N):
        for b in range(pii.N):
            for c in range(pii.N):
                p = np.exp(u[0, a] + u[1, b] + u[2, c] + model.chain[a, b] + model.chain[b, c] - u.max(1).sum())
                want[0, a] += p
                want[1, b] += p
                want[2, c] += p
    assert np.allclose(pii.marginals(flat, model), want / want.sum(1, keepdims=True), atol=1e-4)


def test_chains_of_all_lengths_at_once():
    r = np.random.default_rng(3)
    first = r.random(200) < 0.2
    first[0] = True
    u, psi = r.random((200, pii.N)) + 0.1, r.random((pii.N, pii.N)) + 0.1
    cuts = [*np.flatnonzero(first), 200]
    alone = np.concatenate([pii._chains(u[a:z], np.r_[True, np.zeros(z - a - 1, bool)], psi) for a, z in zip(cuts, cuts[1:])])
    assert np.allclose(pii._chains(u, first, psi), alone)


def test_skips_pull_repeated_tokens_together():
    m = pii.Field(pii.Lexicon(), np.zeros((pii.FEATURES, pii.N)), np.zeros((pii.N, pii.N)), 2 * np.eye(pii.N))
    flat = flat_of(m, "Zoltan here", "there Zoltan")
    assert flat.skips.tolist() == [[0, 3]]
    m.unary[pii.features(flat)[5][0], 5] = 4  # only the first mention has evidence: the word behind it
    p = pii.marginals(flat, m)
    assert p[0].argmax() == 5 and p[3].argmax() == 5 and p[1, 5] < 0.2
    m.skip[:] = 0
    assert pii.marginals(flat, m)[3].max() < 0.2


def test_messages_settle_even_where_they_oscillate():
    m = pii.Field(pii.Lexicon(), np.zeros((pii.FEATURES, pii.N)), -3 * np.eye(pii.N), 4 * (1 - np.eye(pii.N)))
    r = random.Random(1)
    flat = flat_of(m, *[" ".join(r.choice(["Aaaa", "Bbbb", "Cccc", "Dddd"]) for _ in range(12)) for _ in range(6)])
    p = pii.marginals(flat, m)
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1, atol=1e-4)


@pytest.fixture(scope="module")
def given_mails(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/mail_messages.parquet").select("message_id", "sender", "recipients", "body").dropDuplicates(["message_id"])
    lx = pii.learn_lexicon(df)
    rows = [(r.sender, r.recipients, r.body) for r in sorted(df.collect(), key=lambda r: r.message_id * 7919 % 1009)]
    flat = pii.flatten(rows[:300], pii.Vocabulary(lx))
    return lx, rows[300:], pii.train(flat, pii.distant_labels(flat, lx), lx)


def lines(flat, y, kind=None):
    hit = np.flatnonzero(y == 1 + pii.TYPES.index(kind) if kind else y)
    return set(map(tuple, np.stack([flat.doc[hit], flat.where[hit], flat.line[hit], y[hit]], 1).tolist()))


def test_held_out_mails(given_mails):
    """The field, which sees no pattern, finds what the patterns mark in mails it was not trained on."""
    lx, rows, m = given_mails
    flat = pii.flatten(rows, pii.Vocabulary(lx))
    want, got = lines(flat, pii.distant_labels(flat, lx)), lines(flat, pii.decode(flat, m))
    assert len(want & got) > 0.99 * len(want) and len(want & got) > 0.99 * len(got)


def test_ablation(given_mails):
    """With most of the lexicon gone, the field finds names that patterns miss, and the skips find some of them."""
    lx, rows, m = given_mails
    r = random.Random(5)
    thin = pii.Lexicon(*(frozenset(w for w in sorted(x) if r.random() < 0.2) for x in (lx.given, lx.family)))
    whole, flat = (pii.flatten(rows, pii.Vocabulary(x)) for x in (lx, thin))
    want = lines(whole, pii.distant_labels(whole, lx), "name")
    marks = lines(flat, pii.distant_labels(flat, thin), "name")
    field = lines(flat, pii.decode(flat, m), "name")
    no_skips = lines(flat, pii.decode(flat, pii.Field(thin, m.unary, m.chain, 0 * m.skip)), "name")
    assert len(want & marks) < 0.5 * len(want) and len(want & field) > 0.8 * len(want)
    assert len(want & no_skips) < len(want & field) and len(want & field) > 0.98 * len(field)


def test_a_lexicon_too_large_to_travel_is_joined(spark, mails):
    small, joined = (pii.fit(mails, most=n) for n in (pii.LEXICON_WORDS, 0))
    assert joined.lexicon.table is not None and small.lexicon.table is None
    assert sorted(pii.find(mails, joined).collect()) == sorted(pii.find(mails, small).collect())
    assert sorted(map(str, pii.redact(mails, joined).collect())) == sorted(map(str, pii.redact(mails, small).collect()))


def test_empty_table_and_untrained_field(spark):
    empty = spark.createDataFrame([], MAIL)
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


def test_very_long_text(given_mails):
    model = given_mails[2]
    y = pii.decode(flat_of(model, "word " * 9000 + "tamsin@oxbow.test"), model)
    assert len(y) > 9000 and (y > 0).sum() == 3 and pii.LABELS[y[-1]] == "email"


def test_items_far_into_a_field_are_one_run(model):
    """Items across token 2000, and any other, are labelled as in a short field."""
    item = "Tamsin Larkhollow wrote, ring +1 418 555 0140 now"
    short = pii.decode(flat_of(model, "word " * 40 + item), model)[40:]
    assert {pii.LABELS[y] for y in short} == {"other", "name", "phone"}
    for n in range(1985, 2002):
        y = pii.decode(flat_of(model, "word " * n + item), model)
        assert (y[n:] == short).all() and not y[:n].any(), n


def test_redaction_across_token_2000(model):
    body = ["word " * 1999 + "Tamsin Larkhollow"]
    flat = flat_of(model, *body)
    assert pii.redact_mail(None, None, body, flat, pii.decode(flat, model))[2] == ["word " * 1999 + "[NAME]"]


def test_chunks_cut_nothing(mails, model, monkeypatch):
    want = sorted(pii.find(mails, model).collect())
    monkeypatch.setattr(pii, "CHUNK", 3)
    rows = mails.select("message_id", "sender", "recipients", "body").dropDuplicates(["message_id"]).toPandas()
    rows["given"] = rows["family"] = None
    got = pd.concat(pii._lines(model)(iter([rows])))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want))
