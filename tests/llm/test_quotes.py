import random

import numpy as np
import pytest

from worldloom.llm import quotes as Q

MAIL = "message_id bigint, mailbox_oid bigint, msg_number int, sender string, subject string, body array<string>, line_no int, ending int"
TALE = "the old bell over the harbour rang nine times before anybody in the market noticed that the tide had already taken both of the painted boats".split()


def new(spark, rows, **how):
    out = {}
    for r in Q.newly_written(spark.createDataFrame([(*r, 0, 0) for r in rows], MAIL), **how).collect():
        out.setdefault(r.message_id, []).append(r.line_no)
    return {k: sorted(v) for k, v in out.items()}


def test_forms(spark):
    body = [
        "Hi all,", "", "New line.", "-- and then the door fell shut", "* one", "On Wed, 31 Jan 2024 at 09:31, Ann Lee", "<ann@x.test> wrote:", "> old", ">", "Inline answer.", "XY> old", "| old", ": old", ":not_a_mark", "      old",
        "", "Cheers,", "Ann", "-- ", "Ann Lee", "tel 1", "", "CONFIDENTIALITY NOTICE: x", "more", "", "________________________________", "From: B", "Sent: 1", "To: C", "Subject: D", "", "all old",
    ]
    assert new(spark, [(1, 1, 1, "a", "s", body)]) == {1: [1, 3, 4, 5, 10, 14, 17, 18]}


def test_traps(spark):
    body = ["From: the north gate you can see it.", 'She wrote: "no" and I agree.', "|-- cellar", "-> up", "See you there,", "Bo"]
    assert new(spark, [(1, 1, 1, "a", None, body)]) == {1: [1, 2, 3, 4, 5, 6]}


def test_unmarked_quotes_whatever_their_wrapping(spark):
    first = [" ".join(TALE[i : i + 5]) for i in range(0, len(TALE), 5)]
    second = ["I agree with this:", *[" ".join(TALE[i : i + 9]) for i in range(0, len(TALE), 9)], "Shall we?"]
    got = new(spark, [(1, 7, 1, "a", "Bell", first), (2, 7, 2, "b", "Re: RE[2]: bell", second), (3, 8, 3, "c", "bell", second)])
    assert got[1] == list(range(1, len(first) + 1)) and got[2] == [1, len(second)] and got[3] == list(range(1, len(second) + 1))


def test_hot_threads_lose_no_match(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        own = [" ".join(f"w{r.randrange(500)}" for _ in range(12)) for _ in range(4)]
        quoted = rows[r.randrange(len(rows))][5][:4] if rows and r.random() < 0.6 else []
        rows.append((i, 1, i, "s", "", [*own, *quoted]))
    want = {i: [1, 2, 3, 4] for i in range(60)}
    assert new(spark, rows, block_mails=1000) == new(spark, rows, block_mails=7) == want


def test_recurring_endings(spark):
    sig = ["", "Ann Lee, Archive Warden", "Hollow Guild"]
    rows = [(i, i, 1, "Ann (#4)", f"s{i}", [f"Text {i}.", *sig]) for i in range(3)] + [(9, 9, 1, "Bo (#5)", "t", ["Text.", "", "one thing only"])]
    rows += [(10 + i, 20 + i, 1, "Ci (#6)", f"u{i}", ["Text.", "", "Best", "Ci"]) for i in range(3)]
    got = new(spark, rows)
    assert got[0] == got[2] == [1] and got[9] == [1, 3] and got[11] == [1, 3, 4]


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, None, None), (2, 1, 1, "a", "s", []), (3, 1, 2, "a", "s", [None, " ", "x"]), (3, 1, 2, "a", "s", [None, " ", "x"])]
    assert new(spark, rows) == {3: [3]} and new(spark, []) == {}
    text = {r.message_id: r.body for r in Q.new_text(spark.createDataFrame([(*r, 0, 0) for r in rows], MAIL)).collect()}
    assert text == {1: None, 2: None, 3: "x"}


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_brute_force(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc") for _ in range(r.randrange(30))] for _ in range(6)]
    a = Q.Automaton()
    for n, q in enumerate(texts):
        want = np.zeros(len(q), bool)
        for i in range(len(q) - 3):
            if any(q[i : i + 4] == t[j : j + 4] for t in texts[:n] for j in range(len(t) - 3)):
                want[i : i + 4] = True
        assert Q._covered(np.asarray(a.matches(q, 4)[0], int), 4, len(q)).tolist() == want.tolist()
        a.add_text(q)


def test_line_inherited_from_two_blocks(spark):
    """A line that mixes the ends of two matches goes, whatever blocks their first occurrences lie in."""
    rows = []
    for k in range(6):
        a, b = ([f"{c}{k}x{i}" for i in range(30)] for c in "ab")
        third = [" ".join(a[:20]), " ".join(a[20:] + b[:10]), " ".join(b[10:]), f"new{k} words here"]
        rows += [(3 * k, k, 1, "s", "", [" ".join(a)]), (3 * k + 1, k, 2, "s", "", [" ".join(b)]), (3 * k + 2, k, 3, "s", "", third)]
    want = {i: [4] if i % 3 == 2 else [1] for i in range(18)}
    assert new(spark, rows, block_mails=1000) == want
    assert new(spark, rows, block_mails=1) == want


def test_doubtful_marks_are_settled_by_the_automaton(spark):
    """Bars and indents are history where the thread holds the words, layout where it does not; ``>`` is always a quote."""
    old = [" ".join(TALE[:13]), " ".join(TALE[13:])]
    table = ["| lanterns cost four coins each this week", "| ropes cost nine coins and a half each", "      indented code of mine that runs over more than just a few words here"]
    reply = ["Bo wrote:", "| " + " ".join(TALE[:8]), "| " + " ".join(TALE[8:20]), "Prices for the fair:", "      " + " ".join(TALE[20:]), *table, "> a quote of a letter that no table holds, as long as it may be"]
    rows = [(1, 1, 1, "Bo", "fair", old), (2, 1, 2, "Ann", "Re: fair", reply)]
    assert new(spark, rows) == {1: [1, 2], 2: [4, 6, 7, 8]}
    # Without the automaton the quotes behind bars would pass as the sender's own; in a thread's first mail forms decide.
    assert new(spark, rows, min_words=10**6)[2] == [2, 3, 4, 5, 6, 7, 8]
    assert new(spark, rows[1:])[2] == [4]


def test_text_below_a_forwarded_mail_is_kept_where_the_thread_holds_that_mail(spark):
    old = [" ".join(TALE[:13]), " ".join(TALE[13:])]
    mail = ["Hi,", "--- Forwarded message ---", "From: Bo", "Sent: 1", "", *old, "", "And this is what I think about it, now that I have read the whole of it twice."]
    rows = [(1, 1, 1, "Bo", "bell", old), (2, 1, 2, "Ann", "Fwd: bell", mail), (3, 2, 2, "Ann", "Fwd: bell", mail)]
    got = new(spark, rows)
    assert got[2] == [1, 9] and got[3] == [1]


def test_the_automaton_changes_the_rows_of_the_test_tables(spark):
    mails = spark.read.parquet("/root/testdata/sf0.01/mail_messages.parquet")
    rows = Q.newly_written(mails)
    without = Q.newly_written(mails, min_words=10**6)
    assert without.count() > 1.1 * rows.count()
    assert rows.join(without, ["message_id", "line_no"], "left_anti").isEmpty()


def test_recurring_endings_change_the_rows_of_the_test_tables(spark):
    mails = spark.read.parquet("/root/testdata/sf0.01/mail_messages.parquet")
    assert Q.newly_written(mails, recurring=10**6).count() > Q.newly_written(mails).count()


def test_a_block_that_many_mails_ask_is_doubled(spark, monkeypatch):
    monkeypatch.setattr(Q, "GUESTS", 3)
    r = random.Random(2)
    first = " ".join(f"w{r.randrange(500)}" for _ in range(30))
    rows = [(0, 1, 0, "s", "", [first])] + [(i, 1, i, "s", "", [f"new {i} thing", first]) for i in range(1, 40)]
    assert new(spark, rows, block_mails=4) == {0: [1]} | {i: [1] for i in range(1, 40)}
