"""Evaluation passages in a corpus, by suffix arrays of the corpus.

Each shard of the corpus is one sequence of words.  Its suffixes are sorted by their first ``order`` words (prefix
doubling), every suffix of every evaluation text is binary-searched in it, and the matches are extended to their
longest verbatim length.  The evaluation texts are the stated query set: they are broadcast in blocks of bounded
size, so each corpus scan serves one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.llm.words import Words, words_of

MIN_WORDS = 12
SCHEMA = "doc_id bigint, item_id int, n_words int, doc_word int, item_word int"


def suffix_array(rank: np.ndarray, order: int) -> np.ndarray:
    """Positions sorted by their first ``order`` (or the next power of two) ranks."""
    n, k = len(rank), 1
    r = rank.astype(np.int64)
    sa = np.argsort(r, kind="stable")
    while k < order:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = r[k:] + 1
        key = r * (int(r.max(initial=0)) + 2) + nxt
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        new = np.empty(n, np.int64)
        new[sa] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        r, k = new, 2 * k
        if n and r[sa[-1]] == n - 1:
            break
    return sa


def _bound(seq: np.ndarray, sa: np.ndarray, q: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of each row of ``q`` among the sorted suffixes, all rows at once."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    top = len(seq) - 1
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        at = sa[mid]
        cmp = np.zeros(len(live), np.int8)
        for j in range(q.shape[1]):
            und = np.flatnonzero(cmp == 0)
            if not len(und):
                break
            a, b = seq[np.minimum(at[und] + j, top)], q[live[und], j]
            cmp[und] = np.sign(a - b)
        right = (cmp < 0) | ((cmp == 0) & upper)
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


class Queries:
    """Word hashes of a block of evaluation texts, end to end with a gap after each."""

    def __init__(self, ids: list[int], texts: list[str], min_words: int) -> None:
        w = words_of(texts)
        self.ids, self.min_words, self.words = np.asarray(ids, np.int64), min_words, w
        n = len(texts)
        count = np.bincount(w.text, minlength=n)
        first = np.r_[0, np.cumsum(count)[:-1]] if n else np.zeros(0, np.int64)
        self.at = np.arange(len(w.hash)) - first[w.text]  # word number within its text
        self.left = count[w.text] - self.at
        self.starts = np.flatnonzero(self.left >= min_words)

    def find(self, doc: Words) -> tuple[np.ndarray, ...]:
        """Text number, number of the item in the block, longest length, word numbers in document and item of each maximal match."""
        empty = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(doc.hash) or not len(self.starts):
            return empty
        vocab, inv = np.unique(doc.hash, return_inverse=True)
        # A gap, ranked 0, after each document keeps matches inside it.
        shift = np.arange(len(inv)) + doc.text
        seq = np.zeros(len(inv) + int(doc.text[-1]) + 1, np.int64)
        seq[shift] = inv + 1
        loc = np.searchsorted(vocab, self.words.hash)
        known = vocab[np.minimum(loc, len(vocab) - 1)] == self.words.hash
        code = np.where(known, loc + 1, -1)
        m = self.min_words
        starts = self.starts[np.lib.stride_tricks.sliding_window_view(code, m)[self.starts].min(1) > 0]
        if not len(starts):
            return empty
        q = code[starts[:, None] + np.arange(m)]
        sa = suffix_array(seq, m)
        lo, hi = _bound(seq, sa, q, False), _bound(seq, sa, q, True)
        n = hi - lo
        which = np.repeat(np.arange(len(starts)), n)
        if not len(which):
            return empty
        at = sa[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(which))]
        start = starts[which]
        # Keep matches that cannot be extended to the left, then extend them to the right.
        before = (at > 0) & (self.at[start] > 0)
        same = np.zeros(len(at), bool)
        same[before] = seq[at[before] - 1] == code[start[before] - 1]
        at, start = at[~same], start[~same]
        length = np.full(len(at), m, np.int64)
        live = np.arange(len(at))
        while len(live):
            i, j = at[live] + length[live], start[live] + length[live]
            ok = (length[live] < self.left[start[live]]) & (i < len(seq))
            ok[ok] = seq[i[ok]] == code[j[ok]]
            live = live[ok]
            length[live] += 1
        word = np.searchsorted(shift, at)
        text = doc.text[word]
        first = np.searchsorted(doc.text, text)
        return text, self.words.text[start], length, word - first, self.at[start]


def _search(q: Queries, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0)).cumsum()
            total = int(size[-1]) if len(size) else 0
            cuts = np.unique(np.r_[0, np.searchsorted(size, np.arange(shard_bytes, total, shard_bytes)) + 1, whole.num_rows])
            for a, z in zip(cuts[:-1], cuts[1:]):
                b = whole.slice(a, z - a)
                doc = words_of(b.column(1).to_pylist())
                text, item_no, n, dw, iw = q.find(doc)
                if not len(text):
                    continue
                # Exact check: the letters behind equal hashes are equal.
                spell = lambda w, i: bytes(w.buf[w.start[i] : w.start[i] + w.length[i]]).lower()
                first_doc = np.searchsorted(doc.text, text) + dw
                first_item = np.searchsorted(q.words.text, item_no) + iw
                fine = np.array([all(spell(doc, d + k) == spell(q.words, i + k) for k in range(q.min_words)) for d, i in zip(first_doc, first_item)], bool)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[fine])), *[pa.array(x[fine].astype(np.int32)) for x in (q.ids[item_no], n, dw, iw)]], names=["doc_id", "item_id", "n_words", "doc_word", "item_word"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_chars: int = 8_000_000, shard_bytes: int = 6_000_000) -> DataFrame:
    """Maximal verbatim matches of at least ``min_words`` words: ``doc_id, item_id, n_words, doc_word, item_word``.

    ``docs(doc_id, text)`` is scanned whole, ``items(item_id, text)`` is the query set, broadcast in blocks of
    about ``block_chars`` characters (its size is counted first).  Words are runs of a-z and 0-9 regardless of
    case.  Null texts, texts without words and items shorter than ``min_words`` match nothing; repeated documents
    each get their rows; word numbers count from 0.
    """
    q = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("int").alias("item_id"), "text").distinct()
    blocks = max(1, math.ceil((q.agg(F.sum(F.length("text"))).collect()[0][0] or 0) / block_chars))
    found = []
    for k in range(blocks):
        rows = sorted(q.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        numbered = Queries([r.item_id for r in rows], [r.text for r in rows], min_words)
        found.append(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text IS NOT NULL").mapInArrow(_search(numbered, shard_bytes), SCHEMA))
    return reduce(DataFrame.unionByName, found)


def leaked_pairs(leaks: DataFrame) -> DataFrame:
    """``doc_id, item_id`` once each."""
    return leaks.select("doc_id", "item_id").distinct()


def item_report(leaks: DataFrame) -> DataFrame:
    """Per leaked item: documents that hold it and the longest verbatim passage."""
    per = leaks.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))
    return per.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest_words"))


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The corpus without affected documents; rows with a null ``doc_id`` cannot be referred to and stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
