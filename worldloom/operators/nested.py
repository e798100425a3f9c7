"""Deeply nested records to flat linked rows by vectorised structural indexing.

A whole Arrow batch of JSON texts is one byte buffer.  Bitmaps of quotes, brackets and delimiters are built with
array operations, nesting depth is a prefix sum over them, every container finds its parent by one sorted search
over (depth, position), and paths are joined level by level.  Whether a text is whole JSON is read off the index too:
which token may follow which, inside which bracket.  Nothing recurses, so values may be nested to any depth.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TAGS = (b"int", b"string", b"obj", b"anon", b"error", b"bool", b"waif", b"float", b"list", b"map", b"clear", b"none")
_OPEN, _CLOSE, _QUOTE, _COLON, _COMMA, _OTHER = range(6)


def _kind_table() -> np.ndarray:
    t = np.full(256, _OTHER, np.int8)
    t[[ord("{"), ord("[")]] = _OPEN
    t[[ord("}"), ord("]")]] = _CLOSE
    t[ord('"')], t[ord(":")], t[ord(",")] = _QUOTE, _COLON, _COMMA
    t[[32, 9, 10, 13]] = 9
    return t


_KIND = _kind_table()
_ESCAPE = np.zeros(256, bool)
_ESCAPE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
#: The scalars of JSON, with the three numbers decoders commonly take besides.
_SCALAR = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"


def one_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte buffer, each followed by a line end, and their offsets (last: the buffer's length).

    Null texts are empty.
    """
    joined = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), *(pa.scalar(x, pa.large_string()) for x in ("\n", "")))
    _, offsets, data = joined.buffers()
    starts = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
    if not len(joined):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


class Index:
    """Structural index of many JSON texts: tokens in order with depth, text number and span.

    ``bad`` tells the texts that are not whole JSON.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray) -> None:
        """``starts`` holds the texts' byte offsets and, last, the buffer's length."""
        self.buf, self.starts = buf, starts
        n = len(buf)
        slash = buf == 92
        if slash.any():
            at = np.flatnonzero(slash)
            head = np.r_[True, np.diff(at) != 1]
            run_start = at[head][np.cumsum(head) - 1]
            last = np.r_[head[1:], True]
            odd = last & ((at - run_start) % 2 == 0)
            escaped = np.zeros(n + 1, bool)
            escaped[at[odd] + 1] = True
            quote = (buf == 34) & ~escaped[:n]
            starter = at[(at - run_start) % 2 == 0]
        else:
            quote = buf == 34
            starter = np.zeros(0, np.int64)
        q = np.flatnonzero(quote)
        # Quote parity restarts with each text, so a cut-off text cannot spoil the next.
        q_text = np.searchsorted(starts, q, "right") - 1
        q_first = np.searchsorted(q, starts[:-1])
        opening = (np.arange(len(q)) - q_first[q_text]) % 2 == 0 if len(q) else np.zeros(0, bool)
        n_text = len(starts) - 1
        q_count = np.diff(np.r_[q_first, len(q)])
        self.bad = q_count % 2 == 1
        # Inside a string: after an opening quote up to its closing quote.
        delta = np.zeros(n + 1, np.int8)
        delta[q[opening]] += 1
        closing = q[~opening]
        np.add.at(delta, closing + 1, -1)
        unclosed = np.flatnonzero(self.bad)
        np.add.at(delta, starts[unclosed + 1], -1)
        inside = np.cumsum(delta[:n], dtype=np.int32) > 0
        self._slashes = np.r_[0, np.cumsum(slash, dtype=np.int64)]
        self._check_strings(starter[inside[starter]], inside)
        kind = _KIND[buf]
        kind[inside] = 9
        kind[q[opening]] = _QUOTE
        other = kind == _OTHER
        scalar_start = other & ~np.r_[False, other[:-1]]
        scalar_start[starts[:-1][starts[:-1] < n]] |= other[starts[:-1][starts[:-1] < n]]
        self._check_scalars(other, scalar_start)
        tok = np.flatnonzero((kind < _OTHER) | scalar_start)
        self.pos, self.kind = tok, kind[tok]
        self.text = np.searchsorted(starts, tok, "right") - 1
        self.end_quote = np.full(len(tok), -1, np.int64)
        strings = np.flatnonzero(self.kind == _QUOTE)
        paired = ~self.bad[self.text[strings]]
        if len(strings):
            follow = np.searchsorted(q, self.pos[strings]) + 1
            self.end_quote[strings[paired]] = q[np.minimum(follow, len(q) - 1)][paired]
        step = (self.kind == _OPEN).astype(np.int64) - (self.kind == _CLOSE)
        run = np.cumsum(step)
        first_tok = np.searchsorted(self.text, np.arange(n_text))
        base = np.r_[0, run][first_tok]
        self.depth = run - base[self.text] + (self.kind == _CLOSE)  # a bracket and its partner share a depth; members of a container at depth d are at d
        self._check(n_text, first_tok, run, base)
        opens = np.flatnonzero(self.kind == _OPEN)
        self.opens = opens
        big = len(tok) + 1
        okey = self.depth[opens] * big + opens
        self._osort = opens[np.argsort(okey, kind="stable")]
        self._okeys = np.sort(okey)
        self._big = big
        self.parent = np.full(len(tok), -1, np.int64)
        inner = np.flatnonzero(self.depth - (self.kind == _OPEN) - (self.kind == _CLOSE) >= 1)
        up = np.searchsorted(self._okeys, (self.depth[inner] - (self.kind[inner] == _OPEN) - (self.kind[inner] == _CLOSE)) * big + inner) - 1
        self.parent[inner] = self._osort[np.maximum(up, 0)] if len(self._osort) else -1
        commas = np.flatnonzero(self.kind == _COMMA)
        self._ckeys = np.sort(self.depth[commas] * big + commas)
        self._check_order()

    def _check_strings(self, starter: np.ndarray, inside: np.ndarray) -> None:
        """Mark texts with control characters or unknown escapes in strings."""
        wrong = [np.flatnonzero(inside & (self.buf < 32))]
        last = len(self.buf) - 1
        code = self.buf[np.minimum(starter + 1, last)]
        wrong.append(starter[~_ESCAPE[code]])
        wide = starter[code == ord("u")]
        for i in range(2, 6):
            at = np.minimum(wide + i, last)
            wrong.append(wide[~(_HEX[self.buf[at]] & inside[at])])
        at = np.concatenate(wrong)
        self.bad[np.searchsorted(self.starts, at, "right") - 1] = True

    def _check_scalars(self, other: np.ndarray, scalar_start: np.ndarray) -> None:
        """Mark texts with a bare word that is no number, ``true``, ``false`` or ``null``."""
        at = np.flatnonzero(other)
        if not len(at):
            return
        first = np.flatnonzero(scalar_start[at])
        data = self.buf[at]
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.r_[first, len(at)].astype(np.int64)), pa.py_buffer(data)])
        high = np.add.reduceat((data > 127).astype(np.int64), first) > 0
        fine = np.zeros(len(first), bool)
        plain = np.flatnonzero(~high)
        known = pc.dictionary_encode(words.take(pa.array(plain)))
        if len(plain):
            good = np.asarray(pc.match_substring_regex(known.dictionary.cast(pa.large_string()), _SCALAR))
            fine[plain] = good[np.asarray(known.indices)]
        self.bad[np.searchsorted(self.starts, at[first[~fine]], "right") - 1] = True

    def _check_order(self) -> None:
        """Mark texts in which a token may not follow the one before it, and texts that end too early."""
        k, n = self.kind, len(self.kind)
        if not n:
            return
        opens_text = np.r_[True, self.text[1:] != self.text[:-1]]
        before = np.where(opens_text, -1, np.r_[0, k[:-1]])
        curly_at = np.zeros(n + 1, bool)
        curly_at[:n] = (k == _OPEN) & (self.buf[self.pos] == 123)
        curly = curly_at[self.parent]  # -1 finds the spare place
        key = (k == _QUOTE) & curly & ((before == _OPEN) | (before == _COMMA))
        after_key = np.r_[False, key[:-1]] & ~opens_text
        value = (k == _OPEN) | (k == _OTHER) | ((k == _QUOTE) & ~key)
        ended = ~opens_text & ((before == _CLOSE) | (before == _OTHER) | ((before == _QUOTE) & ~after_key))
        may = np.where(
            after_key,
            k == _COLON,
            np.where(
                ended,
                (k == _CLOSE) | ((k == _COMMA) & (self.parent >= 0)),
                np.where(before == _OPEN, (k == _CLOSE) | key | (value & ~curly), np.where(before == _COMMA, key | (value & ~curly), value)),
            ),
        )
        self.bad[self.text[~may]] = True
        closes_text = np.r_[opens_text[1:], True]
        self.bad[self.text[closes_text & ((k == _COMMA) | (k == _COLON) | key)]] = True

    def _check(self, n_text: int, first_tok: np.ndarray, run: np.ndarray, base: np.ndarray) -> None:
        """Mark texts whose brackets do not balance; bracket kinds must match too."""
        last_tok = np.r_[first_tok[1:], len(self.pos)] - 1
        empty = last_tok < first_tok
        end = np.where(empty, 1, np.r_[run, 0][np.maximum(last_tok, 0)] - base)
        bad = (end != 0) | empty
        low = np.flatnonzero((run - base[self.text]) < 0)
        bad[self.text[low]] = True
        br = np.flatnonzero((self.kind == _OPEN) | (self.kind == _CLOSE))
        order = br[np.lexsort((br, self.depth[br], self.text[br]))]
        ch, kd, tx, dp = self.buf[self.pos[order]], self.kind[order], self.text[order], self.depth[order]
        a = np.flatnonzero(kd == _OPEN)
        nxt = np.minimum(a + 1, len(order) - 1)
        fine = (kd[nxt] == _CLOSE) & (tx[nxt] == tx[a]) & (dp[nxt] == dp[a]) & (ch[nxt] == ch[a] + 2)
        bad[tx[a[~fine]]] = True
        self.bad |= bad

    def ordinal(self, tok: np.ndarray) -> np.ndarray:
        """Position, from 1, among the members of the token's container."""
        d = self.depth[tok] - (self.kind[tok] == _OPEN)
        return np.searchsorted(self._ckeys, d * self._big + tok) - np.searchsorted(self._ckeys, d * self._big + self.parent[tok]) + 1

    def equals(self, tok: np.ndarray, word: bytes) -> np.ndarray:
        """Which string tokens spell ``word``, with or without escapes."""
        text = (self.kind[tok] == _QUOTE) & (self.end_quote[tok] >= 0)
        p = self.pos[tok]
        ok = text & (self.end_quote[tok] - p - 1 == len(word))
        for i, b in enumerate(word):
            ok &= self.buf[np.minimum(p + 1 + i, len(self.buf) - 1)] == b
        for i in np.flatnonzero(text & ~ok & (self._slashes[np.maximum(self.end_quote[tok], 0)] > self._slashes[p])):
            ok[i] = not self.bad[self.text[tok[i]]] and self.string(tok[i]) == word.decode()
        return ok

    def string(self, tok: int) -> str:
        return json.loads(bytes(self.buf[self.pos[tok] : self.end_quote[tok] + 1]))


def spellings(texts: pa.Array) -> pa.Array:
    """One short spelling per JSON value, of whatever depth: a 128-bit hash built from the leaves upwards.

    Field order, white space and escapes make no difference; the order of list items does.  Texts that are no
    whole JSON keep their own spelling behind a ``!``; null stays null.
    """
    out: list[str | None] = [None if t is None else "!" + t for t in texts.to_pylist()]
    if not len(out) or texts.null_count == len(out):
        return pa.array(out, pa.string())
    buf, starts = one_buffer(texts)
    ix = Index(buf, starts)
    n = len(ix.pos)
    stop = np.r_[ix.pos[1:], len(buf)] if n else ix.pos
    named = np.r_[ix.kind[1:] == _COLON, False] & (ix.kind == _QUOTE)

    def leaf(t: int) -> tuple[int, int]:
        word = b"s" + ix.string(t).encode("utf-8", "surrogatepass") if ix.kind[t] == _QUOTE else b"w" + bytes(buf[ix.pos[t] : stop[t]]).rstrip()
        d = blake2b(word, digest_size=16).digest()
        return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")

    h = np.zeros((n, 2), np.uint64)
    good = ~ix.bad[ix.text] if n else np.zeros(0, bool)
    for t in np.flatnonzero(good & ((ix.kind == _QUOTE) | (ix.kind == _OTHER))):
        h[t] = leaf(t)
    member = np.flatnonzero(good & ~named & ((ix.kind == _QUOTE) | (ix.kind == _OTHER) | (ix.kind == _OPEN)))
    # A member's own depth; a container's is that of the members inside it, less one.
    level = ix.depth[member] - (ix.kind[member] == _OPEN)
    order = member[np.argsort(-level, kind="stable")]
    level = np.sort(level)[::-1]
    cuts = np.r_[0, np.flatnonzero(np.diff(level)) + 1, len(level)]
    salts = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    with np.errstate(over="ignore"):
        for a, z in zip(cuts[:-1], cuts[1:]):
            now = order[a:z]
            box = now[ix.kind[now] == _OPEN]
            h[box] = _stir(h[box] + buf[ix.pos[box]].astype(np.uint64)[:, None] * salts)
            inner = now[ix.parent[now] >= 0]
            up = ix.parent[inner]
            in_object = buf[ix.pos[up]] == 123
            place = np.where(in_object[:, None], h[np.maximum(inner - 2, 0)], ix.ordinal(inner).astype(np.uint64)[:, None])
            part = _stir(_stir(place + salts) ^ h[inner])
            for k in (0, 1):
                np.add.at(h[:, k], up, part[:, k])
    tops = member[ix.parent[member] < 0]
    for t in tops:
        out[ix.text[t]] = f"#{int(h[t, 0]):016x}{int(h[t, 1]):016x}"
    return pa.array(out, pa.string())


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flatten_batch(texts: pa.Array, top: str, linked: bool = False, piece_bytes: int = 64_000_000) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, pa.Array, dict]]:
    """Rows of all nodes below the top of each value, in pieces of at most about ``piece_bytes`` of paths.

    ``top`` is ``value`` (a text is one typed value) or ``slots`` (a text is a list of ``[slot, value]``).
    A piece holds the text number, slot text (null for ``value``), path and tag of each node, and, with ``linked``,
    parent paths and scalar contents.  Null, cut-off or otherwise unwhole texts give nothing.
    """
    buf, starts = one_buffer(texts)
    ix = Index(buf, starts)
    good = ~ix.bad
    # Member values: the token after a colon; its name is the token before the colon.
    # Texts that are not whole take no further part: their brackets could reach into their neighbours.
    after = np.flatnonzero(np.r_[False, ix.kind[:-1] == _COLON] & good[ix.text]) if len(ix.pos) else np.zeros(0, np.int64)
    name = after - 2
    is_ = {w: np.zeros(len(ix.pos), bool) for w in (b"type", b"items", b"entries", b"key", b"value")}
    for w, mask in is_.items():
        mask[after[ix.equals(name, w)]] = True
    curly = np.zeros(len(ix.pos), bool)
    curly[ix.opens] = buf[ix.pos[ix.opens]] == 123
    objs = np.flatnonzero(curly & good[ix.text])
    par = ix.parent
    # Containers by role: items and entries lists hang on a value; entries on an entries list; values on the rest.
    gp = lambda t: np.where(t >= 0, par[np.maximum(t, 0)], -1)
    up = par[objs]
    up_ok = up >= 0
    in_items = up_ok & is_[b"items"][np.maximum(up, 0)]
    is_entry = up_ok & is_[b"entries"][np.maximum(up, 0)]
    entry = np.zeros(len(ix.pos), bool)
    entry[objs[is_entry]] = True
    in_entry = up_ok & entry[np.maximum(up, 0)] & (is_[b"key"][objs] | is_[b"value"][objs])
    if top == "value":
        at_top = up == -1
    else:  # [[slot, value], ...]: a value is the second member of a pair in the outermost list
        at_top = up_ok & (ix.depth[objs] == 3) & ~curly[np.maximum(up, 0)] & ~is_[b"items"][np.maximum(up, 0)]
    node_tok = np.concatenate([objs[at_top], objs[in_items], objs[in_entry]])
    place = np.full(len(ix.pos), -1, np.int64)
    order = np.argsort(node_tok, kind="stable")
    node_tok = node_tok[order]
    role = np.concatenate([np.zeros(at_top.sum(), np.int8), np.ones(in_items.sum(), np.int8), np.full(in_entry.sum(), 2, np.int8)])[order]
    place[node_tok] = np.arange(len(node_tok))
    up = par[node_tok]
    holder = np.full(len(node_tok), -1, np.int64)  # the node above
    m1, m2 = role == 1, role == 2
    holder[m1] = place[np.maximum(gp(up[m1]), 0)]
    holder[m2] = place[np.maximum(gp(gp(up[m2])), 0)]
    good_node = np.ones(len(node_tok), bool)
    # Tags: the string member "type" of each value.
    t_val = np.flatnonzero(is_[b"type"] & (ix.kind == _QUOTE))
    tag_tok = np.full(len(node_tok), -1, np.int64)
    owner = place[np.maximum(par[t_val], 0)]
    mine = owner >= 0
    tag_tok[owner[mine]] = t_val[mine]
    tag = np.full(len(node_tok), None, object)
    for w in TAGS:
        has = np.flatnonzero(tag_tok >= 0)
        has = has[ix.equals(tag_tok[has], w)]
        tag[has] = w.decode()
    for i in np.flatnonzero((tag_tok >= 0) & good_node & np.equal(tag, None)):
        tag[i] = ix.string(tag_tok[i])
    # Segments, then paths level by level.
    num = np.ones(len(node_tok), np.int64)
    num[m1] = ix.ordinal(node_tok[m1])
    num[m2] = ix.ordinal(up[m2])
    as_text = pa.array(num).cast(pa.string())
    word = pa.array(np.where(m1, "list:", "map:"))
    tail = pa.array(np.where(m1, "", np.where(is_[b"key"][node_tok], ":key", ":value")))
    seg = pc.binary_join_element_wise(word, as_text, tail, "")
    todo = np.flatnonzero(role > 0)
    dead = holder[todo] < 0
    good_node[todo[dead]] = False
    todo = todo[~dead]
    todo = todo[np.argsort(ix.depth[node_tok[todo]], kind="stable")]
    cuts = np.r_[0, np.flatnonzero(np.diff(ix.depth[node_tok[todo]])) + 1, len(todo)] if len(todo) else np.zeros(1, np.int64)
    levels = [todo[a:z] for a, z in zip(cuts[:-1], cuts[1:])]
    seg_np = np.asarray(seg.to_numpy(zero_copy_only=False), object)
    seg_len = np.asarray(pc.binary_length(seg), np.int64)
    length = np.zeros(len(node_tok), np.int64)  # of the path
    top_of = np.arange(len(node_tok))
    for now in levels:
        up_to = length[holder[now]]
        length[now] = up_to + (up_to > 0) + seg_len[now]
        top_of[now] = top_of[holder[now]]
        good_node[now] &= good_node[holder[now]]
    slot = None
    if top == "slots":
        tops = np.flatnonzero(role == 0)
        slot_text = np.full(len(node_tok), None, object)
        for i in tops:
            t = up[i] + 1  # first member of the pair
            if ix.kind[t] == _QUOTE:
                slot_text[i] = ix.string(t)
            elif ix.kind[t] == _OTHER:
                stop = ix.pos[t + 1]
                slot_text[i] = bytes(buf[ix.pos[t] : stop]).decode().strip()
        slot = slot_text[top_of]
    pick = np.flatnonzero(good_node & (role > 0) & ~np.equal(tag, None))
    value = np.full(len(node_tok), None, object)
    if linked:
        for key in (b"value", b"bits"):
            mask = is_[b"value"] if key == b"value" else np.isin(np.arange(len(ix.pos)), after[ix.equals(name, b"bits")])
            at = np.flatnonzero(mask & ((ix.kind == _QUOTE) | (ix.kind == _OTHER)) & good[ix.text])
            own = place[np.maximum(par[at], 0)]
            for t, o in zip(at[own >= 0], own[own >= 0]):
                value[o] = ix.string(t) if ix.kind[t] == _QUOTE else bytes(buf[ix.pos[t] : ix.pos[t + 1]]).decode().strip()

    def piece(at: np.ndarray, paths, parents) -> tuple:
        extra = {"parent": pa.array(parents, pa.string()), "value": pa.array(value[at], pa.string())} if linked else {}
        slots = pa.array(slot[at], pa.string()) if slot is not None else pa.nulls(len(at), pa.string())
        return ix.text[node_tok[at]], slots, pa.array(paths, pa.string()), pa.array(tag[at], pa.string()), extra

    if int(length[pick].sum()) <= piece_bytes:
        path = np.full(len(node_tok), "", object)
        for now in levels:
            above = path[holder[now]]
            path[now] = np.where(length[holder[now]] == 0, seg_np[now], above + "/" + seg_np[now])
        yield piece(pick, path[pick], path[holder[pick]])
        return
    # Long paths are spelled one after another: nodes stand in document order, so a path goes on from the one before.
    here, paths, parents, rows, size = "", [], [], [], 0
    wanted = np.zeros(len(node_tok), bool)
    wanted[pick] = True
    for i in np.flatnonzero((role > 0) & good_node):
        parent = here[: length[holder[i]]]
        here = parent + "/" + seg_np[i] if parent else seg_np[i]
        if wanted[i]:
            rows.append(i)
            paths.append(here)
            parents.append(parent if linked else "")
            size += len(here)
        if size > piece_bytes:
            yield piece(np.asarray(rows), paths, parents)
            paths, parents, rows, size = [], [], [], 0
    if rows:
        yield piece(np.asarray(rows), paths, parents)


def scalar_spans(texts: pa.Array, tag: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the contents of all nodes of a kind stand: text number and byte span in that text, and the bytes of all texts.

    Texts that are not whole JSON have none.  A quoted content's span includes its quotes.
    """
    buf, starts = one_buffer(texts)
    ix = Index(buf, starts)
    none = np.zeros(0, np.int64)
    if not len(ix.pos):
        return none, none, none, buf
    after = np.flatnonzero(np.r_[False, ix.kind[:-1] == _COLON] & ~ix.bad[ix.text])
    kinds = after[ix.equals(after - 2, b"type")]
    nodes = ix.parent[kinds[ix.equals(kinds, tag.encode())]]
    held = np.zeros(len(ix.pos), bool)
    held[nodes] = True
    values = after[ix.equals(after - 2, b"value")]
    values = values[((ix.kind[values] == _QUOTE) | (ix.kind[values] == _OTHER)) & held[ix.parent[values]]]
    begin = ix.pos[values]
    # A bare content ends where white space or the next mark begins.
    white = np.flatnonzero((buf == 32) | (buf == 9) | (buf == 10) | (buf == 13))
    blank = np.r_[white, len(buf)][np.searchsorted(white, begin)]
    follow = np.r_[ix.pos, len(buf)][values + 1]
    stop = np.where(ix.kind[values] == _QUOTE, ix.end_quote[values] + 1, np.minimum(blank, follow))
    text = ix.text[values]
    return text, begin - starts[text], stop - starts[text], buf


def _flatten(top: str, linked: bool, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column(3)), 0)).cumsum()
            cuts = np.unique(np.r_[0, np.searchsorted(size, np.arange(chunk_bytes, size[-1] if len(size) else 0, chunk_bytes)) + 1, whole.num_rows])
            for a, z in zip(cuts[:-1], cuts[1:]):
                b = whole.slice(a, z - a)
                for text, slot, path, tag, extra in flatten_batch(b.column(3), top, linked):
                    take = pa.array(text)
                    member = slot if top == "slots" else b.column(2).take(take)
                    cols = [b.column(0).take(take), b.column(1).take(take), member, path, tag]
                    names = ["holder_kind", "holder_id", "member", "path", "tag"]
                    if linked:
                        cols += [extra["parent"], extra["value"]]
                        names += ["parent_path", "scalar"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def flatten_values(values, top: str = "value", linked: bool = False, chunk_bytes: int = 4_000_000):
    """Flat node rows of ``values(holder_kind, holder_id, member, text)``.

    Columns ``holder_kind, holder_id, member, path, tag`` and, with ``linked``, ``parent_path`` ('' below the top)
    and ``scalar``.  ``chunk_bytes`` bounds the buffer indexed at once; single texts may be longer.  Null and
    unwhole texts, scalars and empty containers give no rows.
    """
    schema = "holder_kind string, holder_id bigint, member string, path string, tag string" + (", parent_path string, scalar string" if linked else "")
    return values.select("holder_kind", "holder_id", "member", "text").mapInArrow(_flatten(top, linked, chunk_bytes), schema)
