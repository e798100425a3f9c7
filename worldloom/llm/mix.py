"""Mixing sources to target token shares by Poisson replication.

Every document is drawn a Poisson number of times, found by inverting the distribution at a uniform number hashed
from the document and a seed, so a rerun or a lost executor draws the same corpus.  The distribution is cut at the
source's cap and its mean is solved so that the cut distribution still has the wanted repetition rate.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenization pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The public tokenizer at ``path``, read once per worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_counts(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document's whole text; a null text has no tokens.

    The vocabulary file is the driver's; Spark hands it to the executors.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name), pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def _tail(lam: float, cap: int) -> list[float]:
    """P(N >= k) for k = 1..cap of a Poisson number with mean ``lam``."""
    p = q = math.exp(-lam)
    out = []
    for k in range(1, cap + 1):
        out.append(max(0.0, 1.0 - q))
        p *= lam / k
        q += p
    return out


def capped_poisson(rate: float, cap: int) -> list[float]:
    """Tail probabilities of a Poisson number cut at ``cap`` whose mean is ``rate``; all ones where rate reaches cap."""
    if rate >= cap:
        return [1.0] * cap
    if rate <= 0:
        return [0.0] * cap
    lo, hi = 0.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(_tail(mid, cap)) < rate else (lo, mid)
    return _tail(lo, cap)


@dataclass(frozen=True)
class Plan:
    """Per source: share wanted, cap, tokens there are, rate and tail probabilities; ``total`` tokens wanted."""

    total: float
    sources: dict[str, dict]


def plan_mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> Plan:
    """Repetition rates from the sources' token totals.

    ``targets(source, target_share, max_repeats)`` has one row per source and is read by the driver; so are the
    totals of just these sources.  Without ``total_tokens`` the mix is the largest that keeps every cap.  Shares
    are normalised over the sources that have tokens; sources without any can give nothing.  A ``total_tokens``
    beyond the caps is cut to what the caps allow.  Documents of other or null sources are not drawn.
    """
    want = {r.source: r for r in targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").dropDuplicates(["source"]).collect()}
    have = {r.source: r for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").collect()}
    able = {s: t for s, t in want.items() if s in have and have[s].tokens}
    shares = sum(t.target_share for t in able.values())
    limits = [t.max_repeats * have[s].tokens * shares / t.target_share for s, t in able.items()]
    total = min([*limits, *([total_tokens] if total_tokens is not None else [])], default=0)
    out = {}
    for s, t in want.items():
        tokens = have[s].tokens if s in have else 0
        rate = total * t.target_share / shares / tokens if s in able else 0.0
        rate = min(rate, float(t.max_repeats)) if rate < t.max_repeats * (1 - 1e-12) else float(t.max_repeats)
        out[s] = {"share": t.target_share, "cap": int(t.max_repeats), "tokens": tokens, "docs": have[s].docs if s in have else 0, "rate": rate, "tail": capped_poisson(rate, int(t.max_repeats))}
    return Plan(float(total), out)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def draws(plan: Plan, seed: int) -> Column:
    """How often a document is drawn."""
    u = uniform(F.lit(seed), F.col("doc_id"))
    n = F.lit(0)
    for s, p in plan.sources.items():
        hits = sum(((u < t).cast("int") for t in p["tail"]), F.lit(0))
        n = F.when(F.col("source") == s, hits).otherwise(n)
    return n


def draw(docs: DataFrame, plan: Plan, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """The mixed corpus: ``doc_id, source, copy, text``, copies from 1, in globally shuffled order.

    The shuffle key is hashed from document, copy and seed, so a hot source spreads over all partitions.
    """
    drawn = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").withColumn("__n", draws(plan, seed)).filter("__n > 0")
    copies = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"), "text")
    keyed = copies.withColumn("__key", F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "copy"))
    spread = keyed.repartition(partitions, "__key") if partitions else keyed.repartition("__key")
    return spread.sortWithinPartitions("__key").drop("__key")


def report(counts: DataFrame, plan: Plan, seed: int = 1) -> DataFrame:
    """Shares reached: one row per target source, from the same draws as the corpus."""
    spark = counts.sparkSession
    rows = [(s, p["share"], p["cap"], p["docs"], p["tokens"], p["rate"]) for s, p in plan.sources.items()]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, rate double")
    n = draws(plan, seed)
    got = counts.select("source", "n_tokens", n.alias("n")).filter("n > 0").groupBy("source").agg(F.sum("n").alias("drawn"), F.sum(F.col("n") * F.col("n_tokens")).alias("drawn_tokens"), F.max("n").alias("most_repeats"))
    out = base.join(F.broadcast(got), "source", "left").fillna(0, ["drawn", "drawn_tokens", "most_repeats"])
    everything = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    return out.crossJoin(F.broadcast(everything)).select(*out.columns, F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))


def counted(docs: DataFrame, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Token counts written once: totals, draws and report read them again instead of tokenizing twice."""
    return materialize(token_counts(docs, path, pattern), "tokens")
