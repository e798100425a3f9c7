"""Queries of the text problems and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldloom.llm import leak, mix, pii, quotes, subject
from worldloom.session import materialize
from worldloom.sources.tables import table


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leak.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaked_pairs(_leaks(spark, sf))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the passages stand: every longest verbatim match with its place in document and item, in words from 0."""
    return _leaks(spark, sf).select("doc_id", "item_id", "n_words", "doc_word", "item_word").distinct()


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return leak.item_report(_leaks(spark, sf))


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    return leak.without_leaks(table(spark, sf, "documents"), _leaks(spark, sf)).select("doc_id", "source", "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "mail_messages"))


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redact(table(spark, sf, "mail_messages"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.newly_written(table(spark, sf, "mail_messages"))


def p5_texts(spark: SparkSession, sf: str) -> DataFrame:
    return quotes.new_text(table(spark, sf, "mail_messages"))


def p9_mixed(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mix.draw(docs, mix.plan_mix(mix.counted(docs), table(spark, sf, "mix_targets")))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = mix.counted(table(spark, sf, "documents"))
    return mix.report(counts, mix.plan_mix(counts, table(spark, sf, "mix_targets")))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    seg = materialize(subject.segments(table(spark, sf, "documents")), "segments")
    return subject.assign(seg, subject.fit(seg, table(spark, sf, "subjects"), table(spark, sf, "subject_labels")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf)


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Composition of the corpus by subject."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    by = docs.join(_subjects(spark, sf), "doc_id", "left").groupBy("subject")
    return by.agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p8_report": p8_report,
    "p8_clean": p8_clean,
    "p9_mixed": p9_mixed,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

_SHINGLES = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
  ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
  es AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
  pairs AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (s))"""

#: Shared runs of twelve words and more: windows that follow each other on one diagonal are one run.
_RUNS = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
  ds AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
  es AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM e)),
  hits AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM ds JOIN es USING (s)),
  runs AS (SELECT doc_id, item_id, min(i) AS i, min(i) - diagonal AS j, count(*) + 11 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM hits) GROUP BY doc_id, item_id, diagonal, run)"""

ORACLES: dict[str, str] = {
    "p8_found": f"WITH {_SHINGLES} SELECT doc_id, item_id FROM pairs",
    "p8_spans": f"WITH {_RUNS} SELECT doc_id, item_id, n::INT AS n_words, (i - 1)::INT AS doc_word, (j - 1)::INT AS item_word FROM runs",
    "p8_report": f"WITH {_RUNS} SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n)::INT AS longest_words FROM runs GROUP BY item_id",
    "p8_clean": f"WITH {_SHINGLES} SELECT doc_id, source, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)",
}
