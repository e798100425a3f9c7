"""Subject areas of documents by term weighting, truncated SVD and refined seed centroids.

Documents are cut into segments (the message, its lines, and the content lines of each changed file), since one
document may touch several subjects.  Terms are hashed words of whole texts.  A term's weight is its inverse
document frequency times how unevenly the hand-labelled seeds spread over subjects where it occurs.  The truncated
SVD of the weighted segment-term matrix is found by subspace iteration: every pass multiplies the whole matrix by
a thin block, and only thin blocks travel.  Centroids start from the seeds and are refined over all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.llm.words import words_of
from worldloom.session import materialize

TERMS = 1 << 16
#: Line starts of commit exports that are furniture, not subject matter.
FURNITURE = (
    "commit ", "Author:", "AuthorDate:", "Commit:", "CommitDate:", "Date:", "From ", "From:", "changeset:", "user:", "date:", "branch:", "tag:", "parent:", "files:", "description:", "# ",
    "index ", "--- ", "+++ ", "@@", "GIT binary", "Binary files", "literal ", "delta ", "new file", "deleted file", "old mode", "new mode", "similarity", "rename ", "copy ", "Subproject", "\\ No newline", "Merge:",
)
_MESSAGE_FURNITURE = ("Merge ", "Bump ", "Release ", "Signed-off-by:", "Reviewed-by:", "Co-authored-by:", "Acked-by:", "Tested-by:", "Reported-by:", "Cc:", "Fixes #", "Closes #", "(cherry picked", "This reverts", "---", "git-svn-id:", "Change-Id:", "updated-dependencies:", "- dependency-name:", "update-type:", "chore(deps)", "[ci skip]", "#")


#: Parts of paths whose files are no subject matter.
_FILE_FURNITURE = ("package.lock", "package-lock", "yarn.lock", "Cargo.lock", "go.sum", ".lock ", "checksums", "vendor/", "node_modules/", ".min.js")


def cut(text: str) -> list[tuple[int, str]]:
    """Segments of one document: kind (0 message, 1 message line, 2 changed file) and text.

    Lock files, vendored files, checksums and binary files are furniture and give no segment; the message always
    counts, also where nothing else changed or files were only renamed.
    """
    message: list[str] = []
    files: list[list[str]] = []
    here: list[str] | None = message
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith("diff "):
            here = None if any(x in line + " " for x in _FILE_FURNITURE) else []
            if here is not None:
                files.append(here)
        elif line.startswith(("GIT binary", "Binary files")):
            here = None
        elif here is None or line.startswith(FURNITURE):
            continue
        elif here is message:
            bare = line.strip()
            for head in ("Subject:", "summary:", "[PATCH]"):
                if bare.startswith(head):
                    bare = bare[len(head) :].strip()
            if bare and not bare.startswith(_MESSAGE_FURNITURE) and " | " not in bare and not bare.endswith("files changed"):
                message.append(bare)
        else:
            here.append(line)
    files = [f for f in files if f]
    out = [(0, "\n".join(message))] if message else []
    if len(message) > 1:
        out += [(1, m) for m in message]
    return out + [(2, "\n".join(f)) for f in files]


def segments(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, terms, tf``: distinct hashed terms of each segment; words with inner digits are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                texts, kinds, rows = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for kind, seg in cut(t or ""):
                        texts.append(seg)
                        kinds.append(kind)
                        rows.append(i)
                w = words_of(texts, wide=True)
                keep = ~w.mixed & (w.length > 2) & (w.length < 25) if len(w.hash) else np.zeros(0, bool)
                key = w.text[keep].astype(np.int64) * TERMS + (w.hash[keep] % np.uint64(TERMS)).astype(np.int64)
                pairs, tf = np.unique(key, return_counts=True)
                seg = pairs // TERMS
                ends = np.searchsorted(seg, np.arange(len(texts) + 1))
                has = np.flatnonzero(np.diff(ends))
                off = pa.array(np.r_[ends[has], ends[-1]].astype(np.int32)) if len(has) else pa.array([0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.asarray(rows, np.int64)[has])),
                        pa.array(np.asarray(kinds, np.int8)[has]),
                        pa.ListArray.from_arrays(off, pa.array((pairs % TERMS).astype(np.int32))),
                        pa.ListArray.from_arrays(off, pa.array(np.minimum(tf, 30000).astype(np.int16))),
                    ],
                    names=["doc_id", "kind", "terms", "tf"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, kind tinyint, terms array<int>, tf array<smallint>")


@dataclass
class Model:
    """Term weights, SVD basis (terms x rank), unit centroids (subjects x rank), and a typical term's embedded length."""

    subjects: list[str]
    weight: np.ndarray
    basis: np.ndarray
    centroids: np.ndarray
    typical: float = 1.0


def _csr(b: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start offsets, terms and weighted frequencies of a batch's segments (columns terms, tf come last)."""
    terms, tf = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
    n = np.asarray(terms.value_lengths().fill_null(0))
    t = terms.flatten().to_numpy(zero_copy_only=False)
    v = (1 + np.log(tf.flatten().to_numpy(zero_copy_only=False))) * weight[t]
    return np.r_[0, np.cumsum(n)].astype(np.int64), t, v.astype(np.float32)


def _rows_dot(off: np.ndarray, t: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sparse rows times ``m`` (terms x k)."""
    n = len(off) - 1
    if not len(t):
        return np.zeros((n, m.shape[1]), np.float32)
    live = np.flatnonzero(np.diff(off))
    out = np.zeros((n, m.shape[1]), np.float32)
    out[live] = np.add.reduceat(m[t] * v[:, None], off[live], axis=0)
    return out


def _sum_blocks(seg: DataFrame, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``A' A block`` over all segments: each task adds up its share, the sums per term are added by the JVM."""
    k = block.shape[1]
    cols = [f"c{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((TERMS, k), np.float32)
        for b in batches:
            off, t, v = _csr(b, weight)
            y = _rows_dot(off, t, v, block)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            order = np.argsort(t, kind="stable")
            ts = t[order]
            if not len(ts):
                continue
            first = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
            acc[ts[first]] += np.add.reduceat(y[row[order]] * v[order, None], first, axis=0)
        hit = np.flatnonzero(np.abs(acc).sum(1))
        for i in range(0, len(hit), 8000):
            h = hit[i : i + 8000]
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), *[pa.array(acc[h, j]) for j in range(k)]], names=["term", *cols])

    got = seg.filter("kind <> 1").select("terms", "tf").mapInArrow(run, "term int, " + ", ".join(f"{c} float" for c in cols))
    rows = got.groupBy("term").agg(*[F.sum(c).alias(c) for c in cols]).toArrow().to_pandas()  # at most TERMS rows
    out = np.zeros((TERMS, k))
    out[rows["term"]] = rows[cols].to_numpy()
    return out


def _counts(df: DataFrame, by: str | None, labels: list[str]) -> np.ndarray:
    """Segments per term (and label): at most TERMS x labels numbers reach the driver."""
    t = df.select(F.explode("terms").alias("term"), *([by] if by else []))
    rows = t.groupBy("term", *([by] if by else [])).count().toArrow().to_pandas()
    out = np.zeros((TERMS, len(labels) if by else 1))
    col = rows[by].map({s: i for i, s in enumerate(labels)}).to_numpy() if by else np.zeros(len(rows), int)
    out[rows["term"].to_numpy(int), col.astype(int)] = rows["count"]
    return out


def term_weights(df: np.ndarray, n_segments: int, per_label: np.ndarray, label_sizes: np.ndarray, smooth: float = 5.0, min_df: int = 2) -> np.ndarray:
    """Inverse document frequency times squared unevenness over the seed labels."""
    s = per_label.shape[1]
    share = per_label / np.maximum(label_sizes, 1) * label_sizes.mean()
    p = (share + smooth / s) / (share.sum(1, keepdims=True) + smooth)
    uneven = np.maximum(0, 1 + (p * np.log(p)).sum(1) / np.log(max(s, 2)))
    idf = np.log(1 + n_segments / np.maximum(df, 1))
    return np.where(df >= min_df, idf * uneven**2, 0).astype(np.float32)


def _pass(seg: DataFrame, m: Model, least: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all segments, by nearest centroid: sums of unit embeddings, segments per term, and segments.

    Each task adds up its share; at most TERMS + rank + 1 small rows per subject reach the driver.
    """
    k, s = m.basis.shape[1], len(m.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, seen, size = np.zeros((s, k)), np.zeros((s, TERMS)), np.zeros((s, 1))
        for b in batches:
            off, t, v = _csr(b, m.weight)
            x, norm = _embed(off, t, v, m)
            cos = x @ m.centroids.T
            best = cos.argmax(1)
            ok = (norm >= least * m.typical) & (cos[np.arange(len(best)), best] >= near)
            np.add.at(acc, best[ok], x[ok])
            # A message counts for the subjects of its document's files: words of any message then spread evenly.
            doc, kind = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            no = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]).astype(np.int64)])
            files = np.zeros((int(no[-1]) + 1 if len(no) else 0, s), bool)
            f = ok & (kind == 2)
            files[no[f], best[f]] = True
            told = np.zeros((len(best), s), bool)
            told[ok, best[ok]] = True
            msg = (kind == 0) & files.any(1)[no] if len(no) else np.zeros(0, bool)
            told[msg] = files[no[msg]]
            size[:, 0] += told.sum(0)
            row = np.repeat(np.arange(len(best)), np.diff(off))
            for j in range(s):
                seen[j] += np.bincount(t[told[row, j]], minlength=TERMS)
        all_ = np.concatenate([seen, acc, size], axis=1)
        who, what = np.nonzero(all_)
        for i in range(0, len(who), 50_000):
            w, c = who[i : i + 50_000], what[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(all_[w, c])], names=["subject", "what", "total"])

    rows = seg.filter("kind <> 1").select("doc_id", "kind", "terms", "tf").mapInArrow(run, "subject int, what int, total double").groupBy("subject", "what").agg(F.sum("total").alias("total")).toArrow().to_pandas()
    out = np.zeros((s, TERMS + k + 1))
    out[rows["subject"].to_numpy(int), rows["what"].to_numpy(int)] = rows["total"]
    return out[:, TERMS : TERMS + k], out[:, :TERMS].T, out[:, -1]


def _embed(off: np.ndarray, t: np.ndarray, v: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Unit embeddings and the embeddings' lengths."""
    x = _rows_dot(off, t, v, m.basis)
    norm = np.sqrt((x * x).sum(1))
    return x / np.maximum(norm, 1e-9)[:, None], norm


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def fit(seg: DataFrame, subjects: DataFrame, labels: DataFrame, rank: int = 16, power: int = 3, rounds: int = 2, least: float = 1.5, near: float = 0.75, seed: int = 7) -> Model:
    """Fit on all segments; ``labels(doc_id, subject)`` are the seeds, ``subjects(subject, about)`` the areas.

    The first round weighs terms by the labelled documents alone, later rounds by what the round before assigned
    over the whole corpus; each round finds its SVD and refines its centroids.  Labels of unknown subjects are
    ignored, repeated labels count once; without any label for a subject its ``about`` text alone is its seed.
    """
    about = [(r.subject, r.about or "") for r in subjects.filter("subject IS NOT NULL").dropDuplicates(["subject"]).orderBy("subject").collect()]
    names = [a for a, _ in about]
    lab = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject").filter(F.col("subject").isin(names)).distinct()
    body = seg.filter("kind <> 1")
    seeds = materialize(body.join(lab, "doc_id"), "subject-seeds")
    df = _counts(body, None, [])[:, 0]
    n = body.count()
    per = _counts(seeds, "subject", names)
    sizes = np.zeros(len(names))
    for r in seeds.groupBy("subject").count().collect():
        sizes[names.index(r.subject)] = r["count"]
    w = words_of([a for _, a in about], wide=True)
    np.add.at(per, ((w.hash % np.uint64(TERMS)).astype(int), w.text), 1.0)
    sizes += 1
    rng = np.random.default_rng(seed)
    m = Model(names, np.zeros(TERMS, np.float32), np.zeros((TERMS, rank), np.float32), np.zeros((len(names), rank), np.float32))
    for r in range(rounds):
        weight = term_weights(df, n, per, sizes, smooth=2.0 if r == 0 else 5.0)
        q = rng.standard_normal((TERMS, rank)).astype(np.float32)
        for _ in range(power):
            q = np.linalg.qr(_sum_blocks(seg, q, weight))[0].astype(np.float32)
        # A subject's terms, embedded like a segment.
        share = per / np.maximum(sizes, 1)
        start = _unit((share / np.maximum(share.sum(1, keepdims=True), 1e-9) * np.sqrt(df)[:, None] * weight[:, None]).T @ q)
        # Within the SVD space, subjects are told apart in the subspace of their seeds: other directions, such as
        # phrases of one subject, would only blur the cosines.
        inner = np.linalg.qr(start.T.astype(np.float64))[0].astype(np.float32)
        q, start = q @ inner, _unit(start @ inner)
        # The length a term of subject matter has by itself, over all occurrences and weighted by term weight.
        use = df * weight
        typical = float((use * weight * np.sqrt((q * q).sum(1))).sum() / max(use.sum(), 1e-9))
        m = Model(names, weight, q, start, typical)
        sums, per_new, sizes_new = _pass(seg, m, least, near)
        m.centroids = _unit(0.3 * start + _unit(sums))
        per, sizes = per_new + 1e-3 * per, sizes_new + 1e-3 * sizes
    return m


def scores(seg: DataFrame, m: Model) -> DataFrame:
    """``doc_id, kind, norm, cos`` of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, t, v = _csr(b, m.weight)
            x, norm = _embed(off, t, v, m)
            cos = (x @ m.centroids.T).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cos) + 1, dtype=np.int32) * cos.shape[1]), pa.array(cos.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(norm.astype(np.float32)), lists], names=["doc_id", "kind", "norm", "cos"])

    return seg.select("doc_id", "kind", "terms", "tf").mapInArrow(run, "doc_id bigint, kind tinyint, norm float, cos array<float>")


def assign(seg: DataFrame, m: Model, least: float = 0.7, near: float = 0.72, near_line: float = 0.8) -> DataFrame:
    """``doc_id, subject``: every subject near enough to any segment of the document; none where nothing is near.

    ``least`` is the subject matter a segment needs, in lengths of a typical term, ``near`` the cosine for messages and files,
    ``near_line`` that for single message lines, whose few words are easily ambiguous.  Empty and null texts have
    no subject.  Rows are distinct.
    """
    names = F.array(*[F.lit(s) for s in m.subjects])
    s = scores(seg, m).filter(F.col("norm") >= least * max(m.typical, 1e-9))
    bar = F.when(F.col("kind") == 1, F.lit(near_line)).otherwise(F.lit(near))
    hit = s.select("doc_id", bar.alias("bar"), F.posexplode("cos").alias("i", "c")).filter("c >= bar")
    return hit.select("doc_id", F.element_at(names, F.col("i") + 1).alias("subject")).distinct()
