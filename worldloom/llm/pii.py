"""Personal information in mail: a skip-chain conditional random field finds it, typed placeholders replace it.

A mail is three chains of tokens (sender, recipients, and the body with quote marks and line ends taken out of the
way).  Unary potentials come from a token's word, shape and place in the name lexicon and from those of the tokens
around it; neighbours share a transition potential; repeated or similar tokens of one mail share a skip potential.
Marginals come from loopy message passing: exact sum-product along the chains, then messages along the skips, until
they settle.  A last exact check keeps only runs that can be an item of their type.

There are no labelled mails, so the field is trained here by distant supervision on a bounded sample: patterns and
the name lexicon, itself counted over all mails, label the sample, and all potentials are fitted together by
pseudo-likelihood.  The patterns are only teachers: they are no features and do not run over the corpus.  While
training, a token's word and its place in the lexicon are hidden at random, so that shape, context and the labels of
its other mentions have to speak for it too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.llm.quotes import _STRIP
from worldloom.session import count_rows, materialize

TYPES = ("email", "phone", "id_number", "address", "name")
LABELS = ("other", *TYPES)
N = len(LABELS)
FIELDS = ("sender", "recipients", "body")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
BITS = 18
FEATURES = 1 << BITS
#: Words of the name lexicon that may travel to every task; a larger lexicon is joined to the mails that use it.
LEXICON_WORDS = 500_000
#: Mails, and characters of them, worked on at once in a task; a single mail may be longer.
CHUNK, CHUNK_CHARS = 2500, 3_000_000

#: Titles, words ending street names, and German street openings.
TITLES = frozenset("dr prof mr mrs ms mx miss frau herr sir lady señor señora mme madame".split())
_STREET = "Lane|Road|Street|Square|Crescent|Avenue|Terrace|Row|Hill|Close|Way|Drive|Place|Gardens|Walk|Green|Mews|Parade|Grove|Quay|Court"
_S = r"[ \n]"
_CAP = r"[A-ZÀ-Þ][\w'’-]*"
_TOWN = rf"{_CAP}(?:{_S}{_CAP})?"
_CODE = rf"(?:{_S}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{_S}\d[A-Z]{{2}})"
_STREETS = rf"(?:{_CAP}{_S}){{1,3}}(?:{_STREET})\b"
_NUM = r"\d{1,4}[a-z]?"
#: Forms of the five kinds of items in running text.
EMAIL = re.compile(
    rf"(?<![\w@])[A-Za-z0-9][\w.+-]*(?:@|{_S}@{_S}|{_S}?[(\[{{<]at[)\]}}>]{_S}?)[A-Za-z0-9-]+(?:(?:\.|{_S}?[(\[{{]dot[)\]}}]{_S}?|{_S}dot{_S})\n?[A-Za-z0-9-]+)+|(?<![\w@])[A-Za-z0-9][\w.+-]*{_S}at{_S}[A-Za-z0-9-]+(?:{_S}dot{_S}[A-Za-z0-9-]+)+",
    re.I,
)
PHONE = re.compile(
    rf"(?<![\w#$+.:/-])(?:\+\d{{1,3}}(?:{_S}\(0\)\d{{1,4}}(?:[ \n-]\d{{2,6}}){{1,3}}|[ \n.-]\(?\d{{2,4}}\)?(?:[ \n.-]\d{{3,6}}){{1,2}}|\d{{7,11}})|\(\d{{3}}\){_S}?\d{{3}}[ \n.-]\d{{4}}|\d{{3}}([.-])\d{{3}}\1\d{{4}}|0\d{{3,4}}{_S}\d{{6}}|\d{{10}}|\d{{3}}-\d{{4}})(?!\w|-\w)(?:{_S}ext\.?{_S}?\d{{1,5}})?"
)
ID_NUMBER = re.compile(
    rf"(?<![\w#$+.:/-])(?:[A-Z]{{2}}{_S}\d\d{_S}\d\d{_S}\d\d{_S}[A-Z]|[A-Z]{{2}}\d{{6}}[A-Z]|[A-Z]{{2}}\d{{7}}|\d{{6}}-\d{{4}}|\d{{3}}-\d\d-\d{{4}}|[A-Z]\d{{4}}{_S}\d{{5}}{_S}\d\d|\d{{8}}-[A-Z])(?!\w|-\w)"
)
ADDRESS = re.compile(
    rf"(?<![\w#$.:/-])(?:P\.?{_S}?O\.?{_S}Box{_S}\d{{1,5}}(?:,{_S}(?P<t1>{_TOWN}){_CODE}?)?|(?:(?:Flat|Apt\.?|Unit|Suite){_S}\d{{1,4}}[a-z]?,{_S})?{_NUM}{_S}{_STREETS}(?:,{_S}\d{{1,2}}(?:st|nd|rd|th){_S}floor)?(?:,{_S}(?P<t2>{_TOWN}){_CODE}?)?|{_STREETS}{_S}{_NUM}\b(?:,{_S}\d{{1,2}}(?:st|nd|rd|th){_S}floor)?(?:,{_S}(?P<t3>{_TOWN}){_CODE}?)?|(?:Am|An{_S}der|Im|Auf{_S}dem|Zum|Zur){_S}{_CAP}{_S}{_NUM}(?:,{_S}\d{{5}}{_S}(?P<t4>{_TOWN}))?|{_CAP}(?:straße|strasse|weg|gasse|platz|allee){_S}{_NUM}(?:,{_S}\d{{5}}{_S}(?P<t5>{_TOWN}))?)"
)
_PATTERNS = (EMAIL, PHONE, ID_NUMBER, ADDRESS)
_TOKEN = re.compile(r"([^\W_]+(?:[.'’+_-][^\W_]+)*|[^\w\s]|_+)")
_DISPLAY = re.compile(r"\(#-?\d+\)|<[^>]*>|\b(?:tel|fax|phone)\b.*|\"")
_GIVEN, _FAMILY, _TITLE = 1, 2, 4


@dataclass
class Lexicon:
    """Name words counted over all mails, lower case; ``table`` holds them where they are too many to travel."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    table: DataFrame | None = None


@dataclass
class Field:
    """Weights of the trained field (log potentials)."""

    lexicon: Lexicon
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _shape(w: str) -> str:
    """Letters by case, runs of letters as one; digits each, up to twelve."""
    s = re.sub(r"[^\W\d_]+", lambda m: "".join(dict.fromkeys("A" if c.isupper() else "a" for c in m.group())), w)
    return re.sub(r"\d", "9", s)[:16]


class Vocabulary:
    """Codes of distinct tokens: word, shape, beginning, end and lexicon flags; tokens are coded once."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000) -> None:
        self.lexicon, self.most = lexicon, most
        self.number: dict[str, int] = {}
        self.codes = np.zeros((1024, 6), np.uint64)

    def ids(self, words: list[str]) -> np.ndarray:
        number = self.number
        if len(number) > self.most:  # only a cache: starts anew between batches
            number.clear()
        known = len(number)
        for w in dict.fromkeys(words):
            if w not in number:
                number[w] = len(number)
        out = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(number) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros((max(len(number) - len(self.codes), len(self.codes)), 6), np.uint64)])
        fresh = list(number)[known:] if len(number) > known else []
        for i, w in enumerate(fresh, known):
            low = w.lower()
            lex = 0
            if w[0].isupper():
                lex = _GIVEN * (low in self.lexicon.given) | _FAMILY * (low in self.lexicon.family) | _TITLE * (low in TITLES)
            link = 0
            digit = any(c.isdigit() for c in w)
            if len(w) >= 4 and (digit or w[0].isupper()):
                link = _crc(low if digit else low[:6]) + 1
            self.codes[i] = (_crc("w" + re.sub(r"\d", "9", low)), _crc("s" + _shape(w)), _crc("p" + low[:3]), _crc("q" + low[-3:]), lex, link)
        return out


@dataclass
class Flat:
    """Tokens of many mails end to end."""

    words: list[str]
    ids: np.ndarray
    codes: np.ndarray  # per token: word, shape, beginning, end, lexicon flags, link key
    doc: np.ndarray
    where: np.ndarray  # 0 sender, 1 recipients, 2 body
    line: np.ndarray  # 0, or from 1 in bodies
    start: np.ndarray  # span in the line
    end: np.ndarray
    gap: np.ndarray  # before the token: 0 none, 1 blanks, 2 a line end, 3 more, 4 the chain begins
    first: np.ndarray  # whether the token opens a chain
    skips: np.ndarray  # pairs of linked tokens, earlier and later
    at: np.ndarray  # place in ``text``
    text: str  # all lines without quote marks and outer blanks, joined by line ends


def flatten(mails: list[tuple[str | None, str | None, list[str | None] | None]], vocab: Vocabulary) -> Flat:
    """Tokens of mails ``(sender, recipients, body)``.  Nulls are empty; a field's lines follow each other in one chain."""
    pieces: list[str] = []
    meta: list[tuple[int, int, int, int]] = []
    for d, (sender, recipients, body) in enumerate(mails):
        for where, x in ((0, sender), (1, recipients)):
            if x:
                t = x.lstrip()
                pieces.append(t.rstrip())
                meta.append((d, where, 0, len(x) - len(t)))
        for i, x in enumerate(body if body is not None else (), 1):
            if not x:
                continue
            m = _STRIP.match(x)
            t = (x[m.end() :] if m else x).lstrip()
            cut = len(x) - len(t)
            t = t.rstrip()
            if t:
                pieces.append(t)
                meta.append((d, 2, i, cut))
    text = "\n".join(pieces)
    parts = _TOKEN.split(text)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    words = parts[1::2]
    at, stop = ends[0:-1:2], ends[1::2]
    info = np.asarray(meta, np.int64).reshape(-1, 4)
    begin = np.cumsum([0, *[len(x) + 1 for x in pieces]])[:-1]
    piece = np.searchsorted(begin, at, "right") - 1
    doc, where, line, cut = info[piece].T if len(words) else np.zeros((4, 0), np.int64)
    n = len(words)
    first = np.ones(n, bool)
    first[1:] = (doc[1:] != doc[:-1]) | (where[1:] != where[:-1])
    gap = np.full(n, 4, np.int64)
    if n:
        down = np.r_[0, np.diff(line)]
        gap = np.where(first, 4, np.where(down == 1, 2, np.where(down > 1, 3, (at > np.r_[0, stop[:-1]]).astype(np.int64))))
    ids = vocab.ids(words)
    codes = vocab.codes[ids]
    # Skips: tokens with a capital or digit that repeat, or share their first six letters, in one mail.
    key = codes[:, 5]
    linked = np.flatnonzero(key > 0)
    order = linked[np.lexsort((linked, key[linked], doc[linked]))]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) if len(order) else np.zeros(0, bool)
    skips = np.stack([order[:-1][same], order[1:][same]], 1) if len(order) else np.zeros((0, 2), np.int64)
    offset = cut - begin[piece] if n else at
    return Flat(words, ids, codes, doc, where, line, at + offset, stop + offset, gap, first, skips, at, text)


def _near(x: np.ndarray, chain: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` tokens further within the chain, 0 beyond its ends."""
    n = len(x)
    out = np.zeros_like(x)
    if abs(by) >= n:
        return out
    if by < 0:
        out[-by:] = np.where(chain[-by:] == chain[:by], x[:by], 0)
    else:
        out[:-by] = np.where(chain[:-by] == chain[by:], x[by:], 0)
    return out


def _mixed(*parts: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), (salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(flat: Flat, hidden: np.ndarray | None = None) -> list[np.ndarray]:
    """Hashed features of each token, one array per kind.  Of ``hidden`` tokens only the shape is seen."""
    word, shape, begins, ends, lex = (flat.codes[:, i] for i in range(5))
    if hidden is not None:
        word, begins, ends, lex = (np.where(hidden, 0, x) for x in (word, begins, ends, lex))
    with np.errstate(over="ignore"):
        kind = shape ^ (lex * np.uint64(0x9E3779B97F4A7C15))
    gap = flat.gap.astype(np.uint64)
    chain = np.cumsum(flat.first)
    k = {d: _near(kind, chain, d) if d else kind for d in range(-3, 4)}
    g = {d: _near(gap, chain, d) if d else gap for d in range(-2, 4)}  # the gap before the token at d
    w = {d: _near(word, chain, d) if d else word for d in (-2, -1, 0, 1, 2)}
    groups = [
        (w[0],), (kind,), (begins,), (ends,), (w[-1],), (w[1],), (w[-2],), (w[2],), (w[-1], gap, kind), (kind, g[1], w[1]),
        (k[-1], gap, kind), (kind, g[1], k[1]), (k[-1], gap, kind, g[1], k[1]), (k[-2], g[-1], k[-1], gap, kind), (kind, g[1], k[1], g[2], k[2]),
        (k[-3], k[-2], k[-1], gap, kind), (kind, g[1], k[1], k[2], g[3], k[3]), (k[-2], k[-1], gap, kind, g[1], k[1], k[2]),
    ]
    return [_mixed(*x, salt=i) for i, x in enumerate(groups)]


def distant_labels(flat: Flat, lexicon: Lexicon) -> np.ndarray:
    """Labels of a sample's tokens by patterns and lexicon: email before identity number, phone, address and name."""
    y = np.zeros(len(flat.words), np.int64)
    marks = np.zeros(len(flat.text) + 1, np.int8)
    start = np.flatnonzero(flat.first)
    stop = np.r_[start[1:], len(y)].astype(np.int64)
    towns = _towns(flat, start, stop)
    for s, e in zip(start, stop):
        lo, hi = int(flat.at[s]), int(flat.at[e - 1]) + len(flat.words[e - 1])
        text = flat.text[lo:hi]
        _mark_names(flat, s, e, y, lexicon)
        for label, p in (("address", ADDRESS), ("phone", PHONE), ("id_number", ID_NUMBER), ("email", EMAIL)):
            for m in p.finditer(text):
                a, z = m.span()
                if p is ADDRESS:
                    z = _address_end(m, towns)
                marks[lo + a : lo + z] = 1 + TYPES.index(label)
    got = marks[flat.at]
    return np.where(got > 0, got, y)


def _town(m: re.Match) -> str | None:
    return next((g for g in ("t1", "t2", "t3", "t4", "t5") if m.group(g)), None)


def _towns(flat: Flat, start: np.ndarray, stop: np.ndarray) -> set[str]:
    """Towns of two words: their second word often stands where punctuation or a postcode ends the address."""
    one: dict[str, int] = {}
    two: dict[str, int] = {}
    for s, e in zip(start, stop):
        text = flat.text[int(flat.at[s]) : int(flat.at[e - 1]) + len(flat.words[e - 1])]
        for m in ADDRESS.finditer(text):
            t = _town(m)
            if t is None:
                continue
            parts = re.split(_S, m.group(t).lower())
            one[parts[0]] = one.get(parts[0], 0) + 1
            if len(parts) == 2 and (m.end() > m.end(t) or text[m.end() : m.end() + 1] in (",", ".", ";", "\n", "")):
                two[" ".join(parts)] = two.get(" ".join(parts), 0) + 1
    return {t for t, n in two.items() if n >= max(2, 0.2 * one[t.split(" ")[0]])}


def _address_end(m: re.Match, towns: set[str]) -> int:
    """An address ends with its town: a second capitalised word belongs to it only in a known town."""
    t = _town(m)
    if t is None:
        return m.end()
    parts = re.split(_S, m.group(t))
    if len(parts) == 1 or " ".join(parts).lower() in towns or m.end(t) != m.end():
        return m.end()
    return m.start(t) + len(parts[0])


def _mark_names(flat: Flat, s: int, e: int, y: np.ndarray, lx: Lexicon) -> None:
    """Label given names or initials with family names in any order, and titles with family names."""
    words, gap, name = flat.words, flat.gap, 1 + TYPES.index("name")
    for i in range(s, e):
        w = words[i]
        if not w[0].isupper() or w.lower() not in lx.family:
            continue
        # Backwards: given name, initials and titles before the family name.
        j, lo = i - 1, i
        while j >= s and gap[j + 1] < 3:
            p = words[j]
            low = p.lower()
            if p == ".":
                j -= 1
                continue
            if (len(p) == 1 and p.isupper() and words[j + 1] == ".") or (p[0].isupper() and (low in TITLES or low in lx.given)):
                lo = j
                j -= 1
                continue
            break
        hi = i
        if lo == i and i + 2 < e and words[i + 1] == "," and gap[i + 1] == 0 and gap[i + 2] in (1, 2):
            # Forwards: "Family, Given" or "Family, G."
            g = words[i + 2]
            if g[0].isupper() and g.lower() in lx.given:
                hi = i + 2
            elif len(g) == 1 and g.isupper() and i + 3 < e and words[i + 3] == ".":
                hi = i + 3
        if lo == hi and i + 1 < e and gap[i + 1] in (1, 2):
            # "Family Given" where the given name is not itself followed by a family name.
            g = words[i + 1]
            if g[0].isupper() and g.lower() in lx.given and g.lower() not in lx.family and not (i + 2 < e and words[i + 2].lower() in lx.family):
                hi = i + 1
        if lo < hi:
            y[lo : hi + 1] = name


def train(flat: Flat, y: np.ndarray, lexicon: Lexicon, epochs: int = 6, batch: int = 16384, rate: float = 0.25, decay: float = 1e-7, hide: float = 0.25, far: float = 0.3, seed: int = 5) -> Field:
    """Pseudo-likelihood training.

    Each token's label is predicted from its features and the labels of its chain and skip neighbours, so unary,
    transition and skip potentials are fitted together and none counts evidence twice.  ``hide`` is the share of
    tokens whose word and lexicon flags are hidden, drawn anew in each of ``epochs``; ``far`` that of the tokens far
    from all items which an epoch looks at, with their weight made up.
    """
    w, chain, skip = np.zeros((FEATURES, N)), np.zeros((N, N)), np.zeros((N, N))
    if len(y):
        chained = np.cumsum(flat.first)
        prev, nxt = np.full(len(y), N), np.full(len(y), N)
        prev[1:] = np.where(chained[1:] == chained[:-1], y[:-1], N)
        nxt[:-1] = np.where(chained[1:] == chained[:-1], y[1:], N)
        back, ahead = np.full(len(y), N), np.full(len(y), N)
        if len(flat.skips):
            back[flat.skips[:, 1]], ahead[flat.skips[:, 0]] = y[flat.skips[:, 0]], y[flat.skips[:, 1]]
        sums = [np.full(p.shape, 1e-6) for p in (w, chain, skip)]
        rng = np.random.default_rng(seed)
        pad = lambda p: np.vstack([p, np.zeros(N)])
        near = np.convolve(y > 0, np.ones(7), "same") > 0.5
        for _ in range(epochs):
            x = np.stack(features(flat, rng.random(len(y)) < hide), 1)
            # Far from all items a token stands for several; those left out come in another epoch.
            weight = np.where(near, 1.0, 1.0 / far)
            order = np.flatnonzero(near | (rng.random(len(y)) < far))
            rng.shuffle(order)
            for at in (order[i : i + batch] for i in range(0, len(order), batch)):
                z = w[x[at]].sum(1) + pad(chain)[prev[at]] + pad(chain.T)[nxt[at]] + pad(skip)[back[at]] + pad(skip)[ahead[at]]
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                d = (p / p.sum(1, keepdims=True) - np.eye(N)[y[at]]) * weight[at, None] / len(at)
                rows, place = np.unique(x[at].reshape(-1), return_inverse=True)
                g = np.stack([np.bincount(place, weights=np.repeat(d[:, k], x.shape[1]), minlength=len(rows)) for k in range(N)], 1) + decay * w[rows]
                sums[0][rows] += g * g
                w[rows] -= rate * g / np.sqrt(sums[0][rows])
                by = lambda n: np.stack([np.bincount(n, weights=d[:, k], minlength=N + 1)[:N] for k in range(N)], 1)
                pull = by(back[at]) + by(ahead[at])
                for q, dq, sq in ((chain, by(prev[at]) + by(nxt[at]).T, sums[1]), (skip, (pull + pull.T) / 2, sums[2])):
                    sq += dq * dq
                    q -= rate * dq / np.sqrt(sq)
    return Field(lexicon, w.astype(np.float32), np.clip(chain, -8, 8), np.clip(skip, -4, 4))


def _scores(flat: Flat, m: Field) -> np.ndarray:
    """Unary log potentials."""
    z = np.zeros((len(flat.words), N), np.float32)
    for x in features(flat):
        z += m.unary[x]
    return z


def _chains(u: np.ndarray, first: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Exact sum-product along all chains at once: marginals over positive potentials ``u``, which need not be normalised."""
    start = np.flatnonzero(first)
    length = np.diff(np.r_[start, len(u)])
    order = np.argsort(-length, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Laid out by place in the chain, longest chains first: each step works on one slice.
    live = np.searchsorted(-length[order], -np.arange(length[order[0]] if len(order) else 0), "left")
    offset = np.r_[0, np.cumsum(live)]
    chain = np.cumsum(first) - 1
    to = offset[np.arange(len(u)) - start[chain]] + rank[chain]
    v = np.empty_like(u)
    v[to] = u
    ones = np.ones((u.shape[1],) * 2, u.dtype)
    f, b = np.empty_like(v), np.ones_like(v)
    for t, k in enumerate(live.tolist()):
        o = offset[t]
        x = v[o : o + k]
        if t:
            x = x * (f[offset[t - 1] : offset[t - 1] + k] @ psi)
        np.divide(x, x @ ones, out=f[o : o + k])
    back = psi.T.copy()
    for t in range(len(live) - 2, -1, -1):
        o, k = offset[t + 1], int(live[t + 1])
        x = (v[o : o + k] * b[o : o + k]) @ back
        np.divide(x, x @ ones, out=b[offset[t] : offset[t] + k])
    f *= b
    f /= f @ ones
    return f[to]


def marginals(flat: Flat, m: Field, settled: float = 1e-2) -> np.ndarray:
    """Label marginals by loopy message passing: chains exactly, skips by messages, alternating.

    Mails whose messages have settled take no part in further rounds.  Each round moves the messages by a smaller
    step, so that mails in which they would oscillate settle too.
    """
    n = len(flat.words)
    if not n:
        return np.zeros((0, N))
    z = _scores(flat, m)
    u = np.exp(z - z.max(1, keepdims=True)) + np.float32(1e-9)
    psi, link = np.exp(m.chain).astype(np.float32), np.exp(m.skip).astype(np.float32)
    p = _chains(u, flat.first, psi)
    a, b = flat.skips[:, 0], flat.skips[:, 1]
    if not len(a) or not m.skip.any():
        return p
    to_b, to_a = np.full((len(a), N), 1.0 / N, np.float32), np.full((len(a), N), 1.0 / N, np.float32)
    live = np.ones(len(a), bool)
    r = 0
    while live.any():
        i = np.flatnonzero(live)
        step = 1.0 / (1 + r / 8)
        out = [(x / x.sum(1, keepdims=True)) for x in ((p[a[i]] / to_a[i]) @ link, (p[b[i]] / to_b[i]) @ link.T)]
        move = np.maximum(np.abs(out[0] - to_b[i]).max(1), np.abs(out[1] - to_a[i]).max(1)) * step
        to_b[i] += step * (out[0] - to_b[i])
        to_a[i] += step * (out[1] - to_a[i])
        docs = np.unique(flat.doc[a[i[move > settled]]])
        live = np.isin(flat.doc[a], docs)
        # One pass over the chains of the mails whose messages moved, the settled ones' last step included.
        touched = np.isin(flat.doc, np.unique(flat.doc[a[i]]))
        inbox = u[touched].copy()
        place = np.cumsum(touched) - 1
        inbox[place[b[i]]] *= to_b[i] * N
        inbox[place[a[i]]] *= to_a[i] * N
        p[touched] = _chains(inbox, flat.first[touched], psi)
        r += 1
    return p


def decode(flat: Flat, m: Field) -> np.ndarray:
    """Labels of all tokens, after the check that a run can be an item of its type."""
    y = marginals(flat, m).argmax(1)
    edge = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | flat.first[1:]]) if len(y) else np.zeros(0, np.int64)
    stop = np.r_[edge[1:], len(y)].astype(np.int64)
    found = y[edge] > 0 if len(y) else np.zeros(0, bool)
    for s, e in zip(edge[found].tolist(), stop[found].tolist()):
        words = flat.words[s:e]
        kind = TYPES[y[s] - 1]
        if kind == "name":
            fine = len(words) >= 2 and (sum(len(w) > 1 and w[0].isupper() for w in words) >= 2 or any(len(w) == 1 and w.isupper() for w in words))
        elif kind == "email":
            fine = any(w.lower() in ("@", "at") for w in words)
        else:
            digits = sum(c.isdigit() for w in words for c in w)
            fine = digits >= {"phone": 7, "id_number": 6, "address": 1}[kind] and (kind != "address" or len(words) >= 2)
        if not fine:
            y[s:e] = 0
    return y


_CAPITAL = r"[A-ZÀ-Þ][\w'’-]+"
_TITLED = "(?:(?i:" + "|".join(sorted(TITLES)) + r")\.? )"
_GIVEN_FAMILY = re.compile(rf"{_TITLED}?({_CAPITAL}) (?:[A-Z]\.? )*({_CAPITAL})")
_FAMILY_GIVEN = re.compile(rf"({_CAPITAL}), ({_CAPITAL})(?: [A-Z]\.?)*")
_FAMILY_ONLY = re.compile(rf"(?:{_TITLED}|(?:[A-Z]\. )+)({_CAPITAL})")


def _display(text: str) -> tuple[str | None, str | None]:
    """Given and family name of a display name, as far as its form tells them."""
    if m := _GIVEN_FAMILY.fullmatch(text):
        if m.group(1).lower() not in TITLES:
            return m.group(1), m.group(2)
    if m := _FAMILY_GIVEN.fullmatch(text):
        return m.group(2), m.group(1)
    if m := _FAMILY_ONLY.fullmatch(text):
        return None, m.group(1)
    return None, None


def _display_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        hits: dict[tuple[str, bool], int] = {}
        for s, r in zip(b["sender"], b["recipients"]):
            for part in [s or "", *re.split(r"(?<=\)),|(?<=>),|;", r or "")]:
                given, family = _display(_DISPLAY.sub(" ", part).strip(" ,"))
                for w, is_given in ((given, True), (family, False)):
                    if w:
                        hits[w.lower(), is_given] = hits.get((w.lower(), is_given), 0) + 1
        yield pd.DataFrame([(w, n if g else 0, 0 if g else n) for (w, g), n in hits.items()], columns=["word", "given", "family"])


def learn_lexicon(mails: DataFrame, most: int = LEXICON_WORDS) -> Lexicon:
    """Name words counted over the display names of all mails.

    Display names that hold two capitalised words (with titles and initials), in either order, give given and
    family names; a word that is mostly the other part of names is not this part.  Up to ``most`` words (counted)
    are taken to the driver and travel with the field; more of them stay a table.
    """
    sums = mails.select("sender", "recipients").mapInPandas(_display_words, "word string, given bigint, family bigint").groupBy("word").agg(F.sum("given").alias("g"), F.sum("family").alias("f"))
    flags = materialize(sums.select("word", ((F.col("g") > 0) & (F.col("g") >= 0.2 * F.col("f"))).alias("given"), ((F.col("f") > 0) & (F.col("f") >= 0.2 * F.col("g"))).alias("family")), "lexicon")
    if count_rows(flags) > most:
        return Lexicon(table=flags)
    rows = flags.collect()
    return Lexicon(frozenset(r.word for r in rows if r.given), frozenset(r.word for r in rows if r.family))


def _with_lexicon(mails: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Mails with the lexicon words they hold, where the lexicon is too large to travel; else null lists."""
    if lexicon.table is None:
        none = F.lit(None).cast("array<string>")
        return mails.select("message_id", "sender", "recipients", "body", none.alias("given"), none.alias("family"))
    text = F.concat_ws(" ", "sender", "recipients", F.array_join("body", " "))
    words = mails.select("message_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{N}'’_+.-]*"), F.lit(0)))).alias("w"))
    hit = words.select("message_id", F.regexp_replace(F.lower("w"), r"[.'’_+-]+$", "").alias("word")).distinct().join(lexicon.table, "word")
    lists = hit.groupBy("message_id").agg(*[F.collect_list(F.when(F.col(k), F.col("word"))).alias(k) for k in ("given", "family")])
    return mails.select("message_id", "sender", "recipients", "body").join(lists, "message_id", "left")


def _local(m: Field, b: pd.DataFrame) -> Lexicon:
    if not any(x is not None for x in b["given"]):
        return m.lexicon
    return Lexicon(*(frozenset(w for x in b[k] if x is not None for w in x) for k in ("given", "family")))


def fit(mails: DataFrame, sample_mails: int = 2000, seed: int = 3, most: int = LEXICON_WORDS) -> Field:
    """The trained field.  The lexicon is counted over all mails; ``sample_mails`` hashed ones are labelled for training."""
    one = mails.select("message_id", "sender", "recipients", "body")
    lx = learn_lexicon(one, most)
    sample = one.orderBy(F.xxhash64("message_id", F.lit(seed)), "message_id").limit(sample_mails)
    rows = _with_lexicon(sample, lx).toPandas()
    known = _local(Field(lx, *[np.zeros(0)] * 3), rows)
    flat = flatten(list(zip(rows["sender"], rows["recipients"], rows["body"])), Vocabulary(known))
    return train(flat, distant_labels(flat, known), lx)


def _chunks(m: Field):
    """Flattened chunks of batches with their labels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Flat, np.ndarray]]:
        vocab = Vocabulary(m.lexicon)
        for whole in batches:
            size = np.cumsum([sum(len(x) for x in body if x) if body is not None else 0 for body in whole["body"]])
            cuts = np.flatnonzero(np.diff(np.r_[-1, np.maximum(size // CHUNK_CHARS, 0) * len(size) + np.arange(len(size)) // CHUNK])) if len(size) else []
            for i, z in zip(cuts, [*cuts[1:], len(size)]):
                b = whole.iloc[i:z]
                lx = _local(m, b)
                if lx is not m.lexicon:
                    vocab = Vocabulary(lx)
                flat = flatten(list(zip(b["sender"], b["recipients"], b["body"])), vocab)
                yield b, flat, decode(flat, m)

    return run


def _bare(m: Field) -> Field:
    """The field as it travels to the tasks: without a table."""
    return Field(Lexicon(m.lexicon.given, m.lexicon.family), m.unary, m.chain, m.skip)


def _lines(m: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, flat, y in _chunks(m)(batches):
            hit = np.flatnonzero(y)
            rows = np.unique(np.stack([flat.doc[hit], flat.where[hit], flat.line[hit], y[hit]]), axis=1)
            ids = b["message_id"].to_numpy(object)[rows[0]]
            yield pd.DataFrame({"message_id": ids, "field": np.asarray(FIELDS, object)[rows[1]], "line_no": rows[2], "pii_type": np.asarray(LABELS, object)[rows[3]]})

    return run


def find(mails: DataFrame, m: Field | None = None) -> DataFrame:
    """``message_id, field, line_no, pii_type``: each line that carries part of an item, once per type.

    ``field`` is sender, recipients (line 0) or body (lines from 1).  Null fields, null lines and empty texts hold
    nothing; rows without a message_id are left out; repeated rows of a message are read once; names are found as far as the mails themselves teach them.
    """
    m = m or fit(mails)
    one = mails.filter("message_id IS NOT NULL").select("message_id", "sender", "recipients", "body").dropDuplicates(["message_id"])
    return _with_lexicon(one, m.lexicon).mapInPandas(_lines(_bare(m)), "message_id bigint, field string, line_no int, pii_type string")


def redact_mail(sender: str | None, recipients: str | None, body: list[str | None] | None, flat: Flat, y: np.ndarray, begin: int = 0, end: int | None = None) -> tuple:
    """The three fields with every item replaced by its placeholder; an item over two lines leaves one in each.

    ``begin`` and ``end`` bound the mail's tokens in ``flat``.
    """
    texts = {0: [sender], 1: [recipients], 2: list(body) if body is not None else None}
    t = (len(y) if end is None else end) - 1
    while t >= begin:
        if not y[t]:
            t -= 1
            continue
        e = t
        where, line = int(flat.where[t]), int(flat.line[t])
        while t > begin and y[t - 1] == y[e] and flat.where[t - 1] == where and flat.line[t - 1] == line:
            t -= 1
        row = line - (1 if where == 2 else 0)
        x = texts[where][row]
        texts[where][row] = x[: flat.start[t]] + PLACEHOLDER[LABELS[y[t]]] + x[flat.end[e] :]
        t -= 1
    return texts[0][0], texts[1][0], texts[2]


def redact(mails: DataFrame, m: Field | None = None) -> DataFrame:
    """``message_id, sender, recipients, body`` with typed placeholders; all other text is kept as it is.

    Rows without a message_id are left out, repeated rows of a message come out once.
    """
    m = m or fit(mails)
    bare = _bare(m)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, flat, y in _chunks(bare)(batches):
            cuts = np.searchsorted(flat.doc, np.arange(len(b) + 1)).tolist()
            rows = list(zip(b["sender"], b["recipients"], b["body"]))
            got = [redact_mail(*r, flat, y, a, z) for r, a, z in zip(rows, cuts, cuts[1:])]
            yield pd.DataFrame({"message_id": b["message_id"].tolist(), "sender": [g[0] for g in got], "recipients": [g[1] for g in got], "body": [g[2] for g in got]})

    one = mails.filter("message_id IS NOT NULL").select("message_id", "sender", "recipients", "body").dropDuplicates(["message_id"])
    return _with_lexicon(one, m.lexicon).mapInPandas(run, "message_id bigint, sender string, recipients string, body array<string>")
