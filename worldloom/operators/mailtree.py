"""Mail kept inside property values: trees of nodes ``{level, entries}`` whose leaves hold message headers.

A node of level 0 holds leaves ``{0 or body property, number, date, sender, recipients, subject, ...}``; a node of a
higher level holds descriptors ``{property, count, ordering}`` of nodes one level below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.operators.inspect import World, value_nodes


def _entries(w: World) -> DataFrame:
    """Nodes of the form ``{level, {...}}``: ``oid, member, level, entry, field, tag, scalar`` of each entry's fields."""
    n = value_nodes(w).select(F.col("holder_id").alias("oid"), "member", "path", "tag", "scalar")
    level = n.filter("path = 'list:1' AND tag = 'int' AND scalar RLIKE '^[0-9]{1,4}$'").select("oid", "member", F.col("scalar").try_cast("int").alias("level"))
    lists = n.filter("path = 'list:2' AND tag = 'list'").select("oid", "member")
    shape = level.join(lists, ["oid", "member"], "left_semi")
    at = lambda i: F.regexp_extract("path", r"^list:2/list:(\d+)/list:(\d+)$", i).try_cast("int")
    fields = n.filter(F.col("path").rlike(r"^list:2/list:\d+/list:\d+$")).select("oid", "member", at(1).alias("entry"), at(2).alias("field"), "tag", "scalar")
    return fields.join(shape, ["oid", "member"])


def messages(w: World) -> DataFrame:
    """Message headers stored in leaves: ``oid, member, entry, number, date, sender, recipients, subject, body_property``."""
    e = _entries(w).filter("level = 0")
    pick = lambda i, tag: F.max(F.when((F.col("field") == i) & (F.col("tag") == tag), F.col("scalar")))
    g = e.groupBy("oid", "member", "entry").agg(pick(2, "int").alias("number"), pick(3, "int").alias("date"), pick(4, "string").alias("sender"), pick(5, "string").alias("recipients"), pick(6, "string").alias("subject"), pick(1, "string").alias("body_property"))
    whole = g.filter("number IS NOT NULL AND date IS NOT NULL AND sender IS NOT NULL AND recipients IS NOT NULL AND subject IS NOT NULL")
    return whole.select("oid", "member", "entry", F.col("number").try_cast("bigint").alias("number"), F.col("date").try_cast("bigint").alias("date"), "sender", "recipients", "subject", "body_property")


def descriptors(w: World) -> DataFrame:
    """Links between nodes: ``oid, member, level, child, declared`` (messages the descriptor says are below)."""
    e = _entries(w).filter("level > 0")
    pick = lambda i, tag: F.max(F.when((F.col("field") == i) & (F.col("tag") == tag), F.col("scalar")))
    g = e.groupBy("oid", "member", "level", "entry").agg(pick(1, "string").alias("child"), pick(2, "int").alias("declared"))
    return g.filter("child IS NOT NULL AND declared IS NOT NULL").select("oid", "member", "level", "child", F.col("declared").try_cast("bigint").alias("declared"))


def broken(w: World) -> DataFrame:
    """Descriptors that disagree with the tree: ``oid, member, child, problem``.

    ``missing`` children do not exist as nodes, ``level`` ones are not one level below, ``count`` ones directly above
    leaves hold another number of messages than declared, ``repeated`` ones are named more than once on an object
    (which every cycle does).
    """
    d = descriptors(w)
    nodes = _entries(w).select("oid", F.col("member").alias("child"), F.col("level").alias("below")).distinct()
    held = messages(w).groupBy("oid", F.col("member").alias("child")).agg(F.count("*").alias("held"))
    named = d.groupBy("oid", "child").agg(F.count("*").alias("named"))
    j = d.join(nodes, ["oid", "child"], "left").join(held, ["oid", "child"], "left").join(named, ["oid", "child"])
    problem = F.when(F.col("named") > 1, "repeated").when(F.col("below").isNull(), "missing").when(F.col("below") != F.col("level") - 1, "level").when((F.col("below") == 0) & (F.coalesce("held", F.lit(0)) != F.col("declared")), "count")
    return j.select("oid", "member", "child", problem.alias("problem")).filter("problem IS NOT NULL")
