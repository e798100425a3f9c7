"""Words of many texts at once, on bytes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)


def _table(extra_letters: bool) -> np.ndarray:
    """Byte to folded byte, 0 where the byte belongs to no word."""
    t = np.zeros(256, np.uint8)
    for b in b"abcdefghijklmnopqrstuvwxyz0123456789":
        t[b] = b
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        t[b] = b + 32
    if extra_letters:
        t[128:] = np.arange(128, 256)
    return t


_ASCII, _WIDE = _table(False), _table(True)
_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * len(_POWERS)) - 1, _P)], dtype=np.uint64)
    return _POWERS


_powers(64 + 1)


@dataclass
class Words:
    """``hash``, byte ``start`` and ``length`` of each word, and the number of the ``text`` it stands in."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray
    mixed: np.ndarray | None = None  # a letter follows a digit, or digits only


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line end after each text, and the offsets of the texts (last: the buffer's length)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), offsets


def words_of(texts: list[str | None], wide: bool = False) -> Words:
    """Words are runs of a-z and 0-9 regardless of case; with ``wide``, bytes beyond ASCII count as letters too.

    Null texts have no words.  Hashes are 64 bits; equal words have equal hashes in every process.
    """
    buf, offsets = join_texts(texts)
    low = (_WIDE if wide else _ASCII)[buf]
    is_ = low > 0
    edge = np.diff(np.r_[False, is_, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - start
    at = np.flatnonzero(is_)
    first = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if len(length) else np.zeros(0, np.int64)
    chars = low[at]
    with np.errstate(over="ignore"):
        inside = np.arange(len(at)) - np.repeat(first, length)
        h = np.add.reduceat(chars.astype(np.uint64) * _powers(int(length.max()) + 1)[inside], first) if len(at) else np.zeros(0, np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    mixed = None
    if wide:
        digit = (chars >= 48) & (chars <= 57)
        turn = np.r_[False, digit[:-1] & ~digit[1:]]
        turn[first] = False
        lead = digit[first] if len(first) else digit
        mixed = (np.add.reduceat(turn.astype(np.int32), first) > 0) | lead if len(first) else np.zeros(0, bool)
        if len(first):  # trailing digits do not count: the word's hash is that of its letters
            n_digit = np.add.reduceat(digit.astype(np.int32), first)
            cut = (n_digit > 0) & ~mixed
            if cut.any():
                with np.errstate(over="ignore"):
                    g = np.add.reduceat(np.where(digit, 0, chars).astype(np.uint64) * _powers(int(length.max()) + 1)[inside], first)
                    g ^= g >> np.uint64(31)
                    g *= np.uint64(0xBF58476D1CE4E5B9)
                    g ^= g >> np.uint64(29)
                h = np.where(cut, g, h)
                length = np.where(cut, length - n_digit, length)
    return Words(h, start, length, np.searchsorted(offsets, start, "right") - 1, buf, offsets, mixed)
