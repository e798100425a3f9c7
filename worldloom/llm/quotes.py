"""Newly written lines of mail: quoted history, signatures, footers and disclaimers removed.

Mails of a thread (mailbox and subject without reply marks) are read in order.  A generalised suffix automaton over
words holds the whole texts of the thread's earlier mails, and every later mail is run through it:

- Text that carries a quote mark or stands below a forwarded head is matched as one sequence, across the lines its
  sender wrote in between.  Marks other than ``>`` (bars, colons, indents, initials) may as well be the sender's own
  layout: in a thread that has earlier mails only inherited words make such lines history, and words below a
  forwarded head that the automaton follows no longer are the sender's.
- Text without marks is history where a match runs across the end of a sentence, or over twice the length: a single
  stock sentence that happens to return is not.

Line forms decide what the thread cannot hold: attributions, forwarded heads, footers, disclaimers, and quotes in a
thread's first mail.  What is left loses the endings that recur among a sender's mails.

Threads above ``block_mails`` are spread over blocks by hash; a mail is sent to every block that holds the first
occurrence of one of its word windows, so no match is lost and no thread is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.session import materialize

#: Words in a row that make a match.  Text without marks needs twice as many, or half as many more with a sentence
#: end that lies ``MARGIN`` words inside.
MIN_WORDS = 12
MARGIN = 6
#: Fewer words than this in a row prove nothing: they follow the form of their line.
SHORT = 12
#: A line is inherited where this share of its words is.
SHARE = 0.8
BLOCK_MAILS = 400
#: Mails sent to a block from others before the block is doubled.
GUESTS = 4 * BLOCK_MAILS

#: Marks that clients put before quoted lines, nested in any order.
QUOTE = re.compile(r"(?:>|\|(?= |$)|:(?= |$)|[A-Z]{2}>|[ \t]{6})")
_STRIP = re.compile(r"^(?:(?:>|\|(?= |$)|:(?= |$)|[A-Z]{2}>) ?|[ \t]{6})+")
#: Attribution lines, as one line.
_WHO = r"""(?:"?[A-ZÀ-Þ][\w'’.,+-]*(?: [A-ZÀ-Þ][\w'’.,-]*){0,3}"?(?: \(#-?\d+\))?(?: <[^<> ]+>)?|<?[\w.+-]+@[\w.-]+>?)"""
_DATED = re.compile(rf"(?:On \w{{3}}, .{{5,120}} wrote:|At \d\d:\d\d [AP]M .{{3,120}} said:|Am \d\d\.\d\d\.\d{{4}} schrieb .{{1,120}}:|>{{5,}} .{{1,120}} wrote:|{_WHO} wrote on \d{{4}}-\d\d-\d\d:)")
_PLAIN = re.compile(rf"(?:{_WHO} (?:writes|wrote|schrieb|said):|Quoting .{{1,110}}:)")
_STARTS = re.compile(r"(?:On \w{3}, \d|At \d\d:\d\d [AP]M \d|Am \d\d\.\d\d\.\d{4} schrieb |>{5,} |Quoting )")
#: Heads of forwarded mail.
_FORWARD = re.compile(r"-{2,} ?(?:Original Message|Original message|Ursprüngliche Nachricht|Forwarded message|Forwarded Message|Weitergeleitete Nachricht|Begin forwarded message) ?-{2,}")
_HEADER = re.compile(r"(?:From|Sent|Date|To|Cc|Subject|Von|Gesendet|Datum|An|Betreff): ?")
#: Footers of lists and clients, and first words of disclaimers.
_FOOTER = re.compile(r"-- You get this because you follow |\*\S.* mailing list$|Use @\w+ \S+ to leave\.|Get \w+ for \w+$|\[ posted with .* \]$|Sent from my |To unsubscribe")
_DISCLAIMER = re.compile(
    r"CONFIDENTIALITY NOTICE|This e-?mail (?:and any|may contain|is confidential|message)|The views in this note are those|The (?:views|opinions) expressed|Diese Nachricht ist vertraulich|Diese E-Mail (?:ist|enthält)|Please consider the (?:trees|environment)|This message (?:and any|is intended|may contain|is confidential)"
)
_CLOSING = re.compile(r"(?:Best|Cheers|Thanks|Thank you|Yours|Regards|Grüße|Gruß|Viele|Liebe|Mit|Many|Kind|Warm|Sincerely|Saludos|Un|Love|Bye|See you|Later|Ciao)\b.{0,25}$")
#: Reply and forward marks of subjects.
_REPLY = r"^(?:(?:re|fw|fwd|aw|sv|wg|antw|vs|tr)(?:\[\d+\]|\(\d+\))? ?: ?)+"
_RULE = re.compile(r"_{10,}|-{10,}")
_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|[.?!]")


def thread_subject(subject: Column) -> Column:
    """A subject without reply and forward marks, case and outer blanks; null counts as empty."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return bare(F.regexp_replace(F.lower(bare(F.coalesce(subject, F.lit("")))), _REPLY, ""))


def roles(body: list[str | None]) -> list[str]:
    """Role of each line by its form: ``own, blank, quote, weak, attribution, forward, forwarded, signature, footer``.

    ``weak`` lines carry another quote mark than ``>``; ``forwarded`` ones stand below the head lines of a ``forward``.
    """
    # White lines keep their first blanks: six of them are a quote mark.
    lines = [(x or "").rstrip() or (x or "")[:6] for x in body]
    n = len(lines)
    out = ["own"] * n
    i = 0
    while i < n:
        line = lines[i]
        nxt = lines[i + 1] if i + 1 < n else ""
        if not line.strip():
            out[i] = "blank"
            i += 1
            continue
        if line.startswith(">>>>>") or not QUOTE.match(line):
            rule = line[0] in "_-" and _RULE.fullmatch(line)
            head = i + 1 if rule else i
            heads = head + 1 < n and _HEADER.match(lines[head]) and _HEADER.match(lines[head + 1])
            if heads or (line[0] == "-" and _FORWARD.fullmatch(line)):
                # The head goes on to the first blank line; below it footers are still told by their form.
                while i < n and lines[i].strip():
                    out[i] = "forward"
                    i += 1
                below = roles(body[i:])
                out[i:] = [r if r in ("blank", "footer", "forward") else "forwarded" for r in below]
                break
            span = _attribution(lines, i)
            if span:
                out[i : i + span] = ["attribution"] * span
                i += span
                continue
        if QUOTE.match(line):
            out[i] = "quote" if line[0] == ">" else "weak"
            i += 1
            continue
        if line in ("--", "---"):
            i = _block(lines, out, i, "signature")
        elif line[0] == "_" and rule:
            i = _block(lines, out, i, "footer" if _FOOTER.match(nxt) else "signature")
        elif line[0] == "=" and re.fullmatch(r"={10,}", line):
            end = _twin(lines, i)
            if end is None:
                i = _block(lines, out, i, "signature")
            else:
                out[i : end + 1] = ["signature"] * (end + 1 - i)
                i = end + 1
        elif line == "***" and _twin(lines, i):
            end = _twin(lines, i)
            out[i : end + 1] = ["footer"] * (end + 1 - i)
            i = end + 1
        elif _DISCLAIMER.match(line):
            i = _block(lines, out, i, "footer")
        elif _FOOTER.match(line):
            out[i] = "footer"
            i += 1
        else:
            i += 1
    return out


def _block(lines: list[str], out: list[str], i: int, role: str) -> int:
    """Mark the lines up to the next blank, footer, quote, attribution or forwarded head."""
    out[i] = role
    j = i + 1
    while j < len(lines) and lines[j].strip():
        x = lines[j]
        if _FOOTER.match(x) or _FORWARD.fullmatch(x) or re.fullmatch(r"_{10,}|\*\*\*", x) or (role != "footer" and _DISCLAIMER.match(x)) or _attribution(lines, j):
            break
        out[j] = role
        j += 1
    return j


def _attribution(lines: list[str], i: int) -> int:
    """How many lines, from ``i``, are one attribution (up to four, the last with a colon); 0 if none."""
    for span in (1, 2, 3, 4):
        if i + span > len(lines) or not lines[i + span - 1].strip():
            return 0
        if not lines[i + span - 1].endswith(":"):
            continue
        joined = " ".join(x.strip() for x in lines[i : i + span])
        after = lines[i + span] if i + span < len(lines) else ""
        quoted = bool(after) and bool(QUOTE.match(after))
        if _DATED.fullmatch(joined) and (span == 1 or _STARTS.match(lines[i]) or quoted):
            return span
        return span if _PLAIN.fullmatch(joined) and quoted else 0
    return 0


def _twin(lines: list[str], i: int) -> int | None:
    """The line that closes the ruled paragraph which ``lines[i]`` opens."""
    for j in range(i + 1, len(lines)):
        if not lines[j].strip():
            return None
        if lines[j] == lines[i]:
            return j
    return None


class Automaton:
    """Generalised suffix automaton over words; texts are added one after another."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _clone(self, q: int, p: int, word: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        return c

    def add_text(self, words: list[str]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(q, last, word)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and q is None:
                nxt[p][word] = cur
                p = link[p]
                q = nxt[p].get(word) if p != -1 else None
            if p != -1:
                link[cur] = q if length[q] == length[p] + 1 else self._clone(q, p, word)
            last = cur

    def matches(self, words: list[str], least: int) -> tuple[list[int], list[int]]:
        """Words at which a match of ``least`` words or more with an added text ends, and the longest matches' lengths."""
        ends, lengths = [], []
        nxt, link, length = self.next, self.link, self.length
        s = k = 0
        for i, w in enumerate(words):
            to = nxt[s].get(w)
            while to is None and s:
                s = link[s]
                k = length[s]
                to = nxt[s].get(w)
            if to is not None:
                s = to
                k += 1
                if k >= least:
                    ends.append(i)
                    lengths.append(k)
        return ends, lengths


def _covered(ends: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``width`` words that ends at one of ``ends``."""
    if not len(ends):
        return np.zeros(n, bool)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, ends + 1 - width, 1)
    np.add.at(mark, ends + 1, -1)
    return np.cumsum(mark[:-1]) > 0


@dataclass
class Mail:
    """Words of a mail: all of them, those with marks or below forwarded heads, and those of lines without marks."""

    body: list[str | None]
    role: list[str]
    all: list[str]
    marked: list[str]
    marked_line: list[int]
    plain: list[str]
    plain_line: list[int]

    def sentence_ends(self) -> np.ndarray:
        """Sentence ends up to and with each plain word."""
        out: list[int] = []
        n = 0
        for line, role in zip(self.body, self.role):
            if role == "own":
                for t in _WORD_OR_END.findall(line.lower()):
                    if t not in ".?!":
                        out.append(n)
                    elif out and out[-1] == n:
                        n += 1
                        out[-1] = n
        return np.asarray(out, np.int64)


def read_mail(body: list[str | None]) -> Mail:
    role = roles(body)
    every, marked, marked_line, plain, plain_line = [], [], [], [], []
    for i, r in enumerate(role):
        if r == "blank":
            continue
        if r == "own":
            found = _WORD.findall(body[i].lower())
            plain += found
            plain_line += [i] * len(found)
        else:
            found = _WORD.findall(_STRIP.sub("", body[i]).lower())
            if r in ("quote", "weak", "forwarded"):
                marked += found
                marked_line += [i] * len(found)
        every += found
    return Mail(body, role, every, marked, marked_line, plain, plain_line)


def _over_end(m: Mail, ends: np.ndarray, width: int) -> np.ndarray:
    """Those windows of plain words, by their last word, that reach ``MARGIN`` words over a sentence end on both sides."""
    if width < 2 * MARGIN or not len(ends):
        return ends[:0]
    stops = m.sentence_ends()
    return ends[stops[ends - MARGIN] > stops[ends - width + MARGIN - 1]]


def inherited(m: Mail, auto: Automaton, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which marked and which plain words the automaton's texts hold."""
    ends, _ = auto.matches(m.marked, min_words)
    marked = _covered(np.asarray(ends, np.int64), min_words, len(m.marked))
    mid, wide = min_words * 3 // 2, 2 * min_words
    ends, k = auto.matches(m.plain, mid)
    if not ends:
        return marked, np.zeros(len(m.plain), bool)
    ends, k = np.asarray(ends), np.asarray(k)
    plain = _covered(_over_end(m, ends, mid), mid, len(m.plain))
    return marked, plain | _covered(ends[k >= wide], wide, len(m.plain))


def decide(m: Mail, marked: np.ndarray, plain: np.ndarray, first: bool) -> list[str]:
    """Roles after the automaton has spoken: ``inherited`` lines go, doubtful ones without history become ``own``."""
    role = list(m.role)
    if not plain.any() and (first or len(m.marked) < SHORT):
        return role
    n = len(role)
    per = lambda lines, which: np.bincount(np.asarray(lines, np.int64)[which], minlength=n) if len(lines) else np.zeros(n, np.int64)
    total, hit = per(m.plain_line, slice(None)), per(m.plain_line, plain)
    for i in np.flatnonzero((hit > 0) & (hit >= SHARE * total)).tolist():
        role[i] = "inherited"
    if first or len(m.marked) < SHORT:
        return role
    # Words in a row that no match covers; too few of them prove nothing.
    turn = np.flatnonzero(np.diff(np.r_[False, ~marked, False].astype(np.int8)))
    runs = [(a, z) for a, z in zip(turn[::2], turn[1::2]) if z - a >= SHORT]
    if not runs:
        return role
    line = np.asarray(m.marked_line)
    below = np.asarray([role[i] == "forwarded" for i in range(n)])
    known = bool(marked[below[line]].any())
    total, hit = per(m.marked_line, slice(None)), per(m.marked_line, marked)
    strange = np.zeros(n, bool)
    for a, z in runs:
        strange[line[a:z]] = True
    for i in np.flatnonzero(strange & (hit < SHARE * total)):
        if role[i] == "weak" or (role[i] == "forwarded" and known):
            role[i] = "own"
    return role


def _ending(body: list[str | None], role: list[str]) -> tuple[list[int], str, bool]:
    """Last own paragraph if it may be a signature: line numbers, its text, and whether its form says so too."""
    own = [i for i, r in enumerate(role) if r == "own"]
    if not own:
        return [], "", False
    # Paragraphs of own lines; a signature stands last, or right before quoted or forwarded text.
    last = own[-1]
    first = last
    while first - 1 in own:
        first -= 1
    lines = [(body[i] or "").strip() for i in range(first, last + 1)]
    named = bool(re.fullmatch(r"[^|]{3,} \| [^|.?!]{3,}", lines[0]))
    if named:
        return list(range(first, last + 1)), "\n".join(lines), True
    plain = not _CLOSING.match(lines[0]) and not any(x.endswith((".", "?", "!", ":", ",", ";")) for x in lines) and sum(len(x.split()) for x in lines) > 1
    if not plain or first == own[0] or first == 0 or role[first - 1] == "own":
        return [], "", False
    return list(range(first, last + 1)), "\n".join(lines), False


def _sender_key(sender: str | None) -> str:
    s = sender or ""
    m = re.search(r"\(#(\d+)\)", s) or re.search(r"[\w.+-]+@[\w.-]+", s)
    return (m.group(1) if m and m.re.groups else m.group(0)).lower() if m else s.strip().lower()


RESULT = "message_id bigint, own array<int>, sender string, ending array<int>, ending_text string, ending_sure boolean, old_marked array<int>, old_plain array<int>"


def _verdict(mid: int, sender: str | None, body: list[str | None], m: Mail, marked: np.ndarray, plain: np.ndarray, first: bool) -> tuple:
    role = decide(m, marked, plain, first)
    end, text, sure = _ending(body, role)
    return (mid, [i + 1 for i, r in enumerate(role) if r == "own"], _sender_key(sender), [i + 1 for i in end], text, sure, None, None)


def _read_threads(min_words: int):
    """Mails sorted by unit and order; one automaton at a time.

    A mail of a thread in one block gets its lines.  Of a split thread a block knows only part of a mail's inherited
    words, so it returns their positions.  ``part`` is source (read, then added), guest (read) or copy (added).
    Repeated rows of a mail stand next to each other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, auto, waiting, before = None, Automaton(), [], None
        for b in batches:
            rows = []
            for u, part, split, first, mid, sender, body in zip(b["unit"], b["part"], b["split"], b["first"], b["message_id"], b["sender"], b["body"]):
                if u != unit:
                    unit, auto, waiting, before = u, Automaton(), [], None
                elif mid == before:
                    continue
                opens, before = before is None, mid
                for words in waiting:  # a thread's last mail is never added
                    auto.add_text(words)
                waiting = []
                body = [] if body is None else list(body)
                m = read_mail(body)
                if part != "guest":
                    waiting = [m.all]
                if part == "copy":
                    continue
                if len(auto.next) > 1:
                    marked, plain = inherited(m, auto, min_words)
                else:
                    marked, plain = np.zeros(len(m.marked), bool), np.zeros(len(m.plain), bool)
                if split:
                    rows.append((mid, None, None, None, None, None, np.flatnonzero(marked).tolist(), np.flatnonzero(plain).tolist()))
                else:
                    rows.append(_verdict(mid, sender, body, m, marked, plain, opens))
            yield pd.DataFrame(rows, columns=["message_id", "own", "sender", "ending", "ending_text", "ending_sure", "old_marked", "old_plain"])

    return run


def _decide_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mails of split threads with the words inherited from any block."""
    for b in batches:
        rows = []
        for first, mid, sender, body, a, p in zip(b["first"], b["message_id"], b["sender"], b["body"], b["old_marked"], b["old_plain"]):
            body = [] if body is None else list(body)
            m = read_mail(body)
            marked, plain = np.zeros(len(m.marked), bool), np.zeros(len(m.plain), bool)
            marked[np.asarray(a, np.int64)] = True
            plain[np.asarray(p, np.int64)] = True
            rows.append(_verdict(mid, sender, body, m, marked, plain, first))
        yield pd.DataFrame(rows, columns=["message_id", "own", "sender", "ending", "ending_text", "ending_sure", "old_marked", "old_plain"])


def _windows(min_words: int):
    """Hashes of word windows of hot threads' mails: those a mail holds, and those that make words of it inherited."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, number, at, body in zip(b["thread"], b["message_id"], b["at"], b["body"]):
                m = read_mail([] if body is None else list(body))
                mid, wide = min_words * 3 // 2, 2 * min_words
                every = lambda words, n: {hash_words(words[i : i + n]) for i in range(len(words) - n + 1)}
                over = _over_end(m, np.arange(mid - 1, len(m.plain)), mid)
                asked = every(m.marked, min_words) | every(m.plain, wide) | {hash_words(m.plain[e + 1 - mid : e + 1]) for e in over.tolist()}
                out += [(t, h, at, number, True) for h in every(m.all, min_words) | every(m.all, mid) | every(m.all, wide)]
                out += [(t, h, at, number, False) for h in asked]
            yield pd.DataFrame(out, columns=["thread", "h", "at", "message_id", "source"])

    return run


def hash_words(words: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def newly_written(mails: DataFrame, min_words: int = MIN_WORDS, block_mails: int = BLOCK_MAILS, recurring: int = 2) -> DataFrame:
    """``message_id, line_no`` of every line its sender newly wrote and that is not blank.

    ``mails(message_id, mailbox_oid, msg_number, sender, subject, body)``; identical repeated rows count once.
    Rows without a message_id are left out.  A null body has no lines, null lines are blank, null subjects are empty, null numbers come first.  Greetings,
    closing words and the handle below them stay.  ``min_words`` in a row make a match with an earlier mail.
    ``recurring`` is the number of a sender's mails in which an ending must return to count as a signature; an
    ending that stands alone counts only if it has a signature's form.
    """
    mails = mails.filter("message_id IS NOT NULL")
    thread = F.xxhash64(F.coalesce("mailbox_oid", F.lit(-1)), thread_subject(F.col("subject"))).alias("thread")
    at = F.struct(F.coalesce("msg_number", F.lit(0)).alias("n"), F.col("message_id").alias("m")).alias("at")
    # Repeated rows are counted here too; that can only split a thread a little earlier.
    threads = mails.select(thread, at).groupBy("thread").agg(F.min("at").alias("first_at"), F.ceil(F.count("*") / block_mails).cast("int").alias("blocks"))
    hot = materialize(threads.filter("blocks > 1"), "hot-threads")
    table = mails.select(thread, at, "message_id", "sender", "body").join(hot, "thread", "left")
    split = F.col("blocks").isNotNull()
    block = F.coalesce(F.pmod(F.xxhash64("message_id"), F.col("blocks")), F.lit(0)).alias("block")
    blocked = table.select("thread", block, split.alias("split"), (F.col("at") == F.col("first_at")).alias("first"), "at", "message_id", "sender", "body")
    rows = blocked.select("thread", "block", F.lit(0).alias("copy"), F.lit("source").alias("part"), "split", "first", "at", "message_id", "sender", "body")
    heat = None
    if not hot.isEmpty():
        heat = materialize(blocked.filter("split").dropDuplicates(["message_id"]), "hot-mails")
        w = materialize(heat.select("thread", "message_id", "at", "body").mapInPandas(_windows(min_words), "thread bigint, h bigint, at struct<n:int,m:bigint>, message_id bigint, source boolean"), "windows")
        home = heat.select("message_id", "block")
        first = w.filter("source").groupBy("thread", "h").agg(F.min("at").alias("first_at")).withColumn("home", F.col("first_at.m"))
        first = first.join(home.withColumnRenamed("message_id", "home"), "home").select("thread", "h", "first_at", "block")
        sent = w.filter("NOT source").join(first, ["thread", "h"]).filter("first_at < at").select("thread", "message_id", "block").distinct()
        sent = materialize(sent.join(home, ["message_id", "block"], "left_anti"), "guests")
        # A block that many mails ask is read several times, each time for some of them.
        copies = materialize(sent.groupBy("thread", "block").agg(F.ceil(F.count("*") / GUESTS).cast("int").alias("copies")), "block-copies")
        guests = heat.drop("block").join(sent.join(copies, ["thread", "block"]), ["thread", "message_id"])
        guests = guests.select("thread", "block", F.pmod(F.xxhash64("message_id", F.lit(3)), F.col("copies")).cast("int").alias("copy"), F.lit("guest").alias("part"), "split", "first", "at", "message_id", "sender", "body")
        again = heat.join(copies.filter("copies > 1"), ["thread", "block"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies") - 1)))
        again = again.select("thread", "block", "copy", F.lit("copy").alias("part"), "split", "first", "at", "message_id", "sender", "body")
        rows = rows.unionByName(guests).unionByName(again)
    units = rows.withColumn("unit", F.xxhash64("thread", "block", "copy")).repartition("unit").sortWithinPartitions("unit", "at")
    read = materialize(units.select("unit", "part", "split", "first", "message_id", "sender", "body").mapInPandas(_read_threads(min_words), RESULT), "mail-roles")
    main = read.filter("own IS NOT NULL")
    if heat is not None:
        found = read.filter("own IS NULL").groupBy("message_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("old_marked", "old_plain")])
        later = heat.join(found, "message_id").select("first", "message_id", "sender", "body", "old_marked", "old_plain")
        main = main.unionByName(materialize(later.mapInPandas(_decide_split, RESULT), "split-roles"))
    # Endings that return in the sender's mails; an ending that stands alone goes by its form.
    ends = main.filter(F.size("ending") > 0)
    often = ends.groupBy("sender", "ending_text").agg(F.count("*").alias("n")).withColumn("often", F.col("n") >= recurring)
    cut = ends.join(often, ["sender", "ending_text"]).filter("often OR (ending_sure AND n = 1)").select("message_id", F.explode("ending").alias("line_no"))
    return main.select("message_id", F.explode("own").alias("line_no")).join(cut, ["message_id", "line_no"], "left_anti")


def new_text(mails: DataFrame, **how: int) -> DataFrame:
    """``message_id, body``: each mail reduced to its newly written lines, in order; null where nothing is new."""
    mails = mails.filter("message_id IS NOT NULL")
    lines = mails.dropDuplicates(["message_id"]).select("message_id", F.posexplode("body").alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    kept = lines.join(newly_written(mails, **how), ["message_id", "line_no"], "left_semi")
    text = kept.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    return mails.select("message_id").distinct().join(text.select("message_id", F.array_join("x.line", "\n").alias("body")), "message_id", "left")
