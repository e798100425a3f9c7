"""Redaction policies: rules bound to what two dumps hold, and events folded accordingly."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators.graph import neighbourhood
from worldloom.operators.inspect import World

KINDS = ("object", "property", "verb")


@dataclass(frozen=True)
class Rule:
    """Protect records of a kind: of one object, of its whole subtree, or wherever the name fits the pattern."""

    name: str
    kind: str
    oid: int | None = None
    subtree: bool = False
    pattern: str = "*"


def load(text: str) -> list[Rule]:
    """Rules of a policy's JSON text; repeated names and numbers JSON does not know are refused."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a name stands twice")
        return dict(pairs)

    def refuse(word: str) -> None:
        raise ValueError(f"{word} is no JSON number")

    data = json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    if not isinstance(data, dict):
        raise ValueError("a policy is an object")
    return parse(data)


def digest(rules: list[Rule]) -> str:
    """SHA-256 of a policy's rules, however its text was spelled and ordered."""
    rows = sorted([r.name, r.kind, r.oid, r.subtree, r.pattern] for r in rules)
    return hashlib.sha256(json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def parse(data: dict) -> list[Rule]:
    """Rules of a policy document ``{"rules": [{"name", "kind", "oid", "subtree", "pattern"}]}``; anything else is refused."""
    rules = data.get("rules")
    if set(data) != {"rules"} or not isinstance(rules, list):
        raise ValueError("a policy holds rules only")
    out = []
    for r in rules:
        if not isinstance(r, dict) or set(r) - {"name", "kind", "oid", "subtree", "pattern"} or r.get("kind") not in KINDS or not r.get("name"):
            raise ValueError("a rule has a name, a kind, and optionally oid, subtree and pattern")
        if r.get("oid") is not None and (isinstance(r["oid"], bool) or not isinstance(r["oid"], int)):
            raise ValueError("oid is a number")
        if r.get("subtree") and r.get("oid") is None:
            raise ValueError("a subtree needs its object")
        out.append(Rule(r["name"], r["kind"], r.get("oid"), bool(r.get("subtree")), r.get("pattern", "*")))
    if len({r.name for r in out}) != len(out):
        raise ValueError("rule names are unique")
    return out


def _records(w: World, kind: str) -> DataFrame:
    if kind == "object":
        return w.objects.select(F.col("id").alias("oid"), "name")
    return (w.properties if kind == "property" else w.verbs).select("oid", "name")


def bind(spark: SparkSession, rules: list[Rule], old: World, new: World) -> DataFrame:
    """``kind, oid, name, rule, side``: every record of either dump that a rule protects."""
    parts = []
    for r in rules:
        for side, w in (("old", old), ("new", new)):
            d = _records(w, r.kind).filter(F.coalesce(moo.fold_ascii("name"), F.lit("")).rlike(moo.glob(r.pattern.lower())))
            if r.oid is not None and not r.subtree:
                d = d.filter(F.col("oid") == r.oid)
            if r.subtree:
                links = w.objects.select(F.explode("parents").alias("src"), F.col("id").alias("dst")).filter("src IS NOT NULL")
                below = neighbourhood(links, spark.createDataFrame([(r.oid,)], "id bigint")).select(F.col("id").alias("oid"))
                d = d.join(below, "oid", "left_semi")
            parts.append(d.select(F.lit(r.kind).alias("kind"), "oid", "name", F.lit(r.name).alias("rule"), F.lit(side).alias("side")))
    if not parts:
        return spark.createDataFrame([], "kind string, oid bigint, name string, rule string, side string")
    return reduce(DataFrame.unionByName, parts)


def match_counts(bound: DataFrame) -> DataFrame:
    """Records protected per rule and side."""
    return bound.groupBy("rule", "side").agg(F.count("*").alias("n"))


def apply(events: DataFrame, bound: DataFrame) -> DataFrame:
    """``kind, oid, name, change`` events with protected ones folded into one ``redacted`` row per object and kind.

    Folding comes before ids, order and counts, so none of them tells how much was hidden.
    """
    mark = bound.select("kind", "oid", "name").distinct().withColumn("hidden", F.lit(1))
    on = (F.col("e.kind") == F.col("m.kind")) & F.col("e.oid").eqNullSafe(F.col("m.oid")) & F.col("e.name").eqNullSafe(F.col("m.name"))
    e = events.alias("e").join(mark.alias("m"), on, "left").select("e.*", "m.hidden")
    shown = e.filter("hidden IS NULL").select("kind", "oid", "name", "change")
    return shown.unionByName(e.filter("hidden = 1").select("kind", "oid", F.lit("").alias("name"), F.lit("redacted").alias("change")).distinct())
