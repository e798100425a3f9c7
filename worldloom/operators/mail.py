"""Mailboxes: selecting, searching and summarising messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators.joins import in_ranges, tail


def messages(mail: DataFrame) -> DataFrame:
    """Each message once; repeated rows are identical."""
    return mail.dropDuplicates(["message_id"])


def headers(mail: DataFrame) -> DataFrame:
    """Listing of messages: number, UTC date (none for null or zero), sender, subject and lines."""
    return messages(mail).select("message_id", "mailbox_oid", "msg_number", moo.clock("date_unix").alias("sent"), "sender", "subject", F.when(F.col("body").isNotNull(), F.size("body")).alias("n_lines"))


def search(mail: DataFrame, text: str) -> DataFrame:
    """Messages with ``text`` in sender, recipients, subject, headers or body, in any case."""
    all_ = F.concat_ws("\n", "sender", "recipients", "subject", F.concat_ws("\n", "headers"), F.concat_ws("\n", "body"))
    return messages(mail).filter(F.contains(F.lower(all_), F.lit(text.lower())))


def select(mail: DataFrame, ranges: list[tuple[int, int]] | None = None, text: str | None = None, last: int | None = None) -> DataFrame:
    """Messages by number ranges and text, then the last of each mailbox."""
    m = search(mail, text) if text else messages(mail)
    m = in_ranges(m, "msg_number", ranges) if ranges else m
    return tail(m, ["mailbox_oid"], ["msg_number", "message_id"], last) if last else m


def lists(mail: DataFrame) -> DataFrame:
    """Mailing lists among recipients (``*Name (#N)``): ``list_name, n_messages``."""
    r = messages(mail).select("message_id", F.explode(F.regexp_extract_all("recipients", F.lit(r"\*(\w+) \(#\d+\)"), F.lit(1))).alias("list_name"))
    return r.groupBy("list_name").agg(F.count_distinct("message_id").alias("n_messages"))


def mailbox_summary(mail: DataFrame) -> DataFrame:
    """Per mailbox: messages, first and last number, numbers missing in between, undated messages."""
    g = messages(mail).groupBy("mailbox_oid").agg(F.count("*").alias("n"), F.min("msg_number").alias("first"), F.max("msg_number").alias("last"), F.count_if(~F.coalesce(F.col("date_unix") > 0, F.lit(False))).alias("n_undated"))
    return g.withColumn("n_gaps", F.col("last") - F.col("first") + 1 - F.col("n"))
