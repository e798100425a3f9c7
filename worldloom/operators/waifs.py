"""Waifs: slots as rows, kinds by class, and who holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.operators import nested
from worldloom.operators.inspect import World, scalar, tag, value_nodes
from worldloom.session import materialize


def slots(w: World) -> DataFrame:
    """``waif_index, waif_class, slot, value_json`` of each set slot; unwhole props give nothing."""
    pairs = F.from_json("props", "array<array<string>>", {"mode": "PERMISSIVE"})
    whole = w.waifs.filter(F.try_parse_json("props").isNotNull())
    return whole.select("waif_index", "waif_class", F.explode(pairs).alias("p")).select("waif_index", "waif_class", F.col("p")[0].try_cast("int").alias("slot"), F.col("p")[1].alias("value_json")).distinct()


def slot_kinds(w: World) -> DataFrame:
    """Per class and slot, how many waifs hold which kind of value."""
    return slots(w).groupBy("waif_class", "slot", tag().alias("tag")).agg(F.count("*").alias("n"))


def sparse_share(w: World) -> DataFrame:
    """Per class: waifs, set slots, and slots their definitions offer."""
    n = slots(w).groupBy("waif_index").agg(F.count("*").alias("n_set"))
    return w.waifs.join(n, "waif_index", "left").groupBy("waif_class").agg(F.count("*").alias("n_waifs"), F.sum(F.coalesce("n_set", F.lit(0))).alias("n_set"), F.sum("propdefs_length").alias("n_slots"))


def slot_names(w: World) -> DataFrame:
    """``waif_class, slot, name``: a class's slots by position, without the leading colon.

    They are the properties spelled ``:name``, the class's own first, then each ancestor's in depth-first order;
    the most remote ancestor that holds a property defines it.  Positions count from 0 over all classes in use.
    """
    from worldloom.operators.inherit import ancestors

    classes = w.waifs.filter("waif_class IS NOT NULL").select(F.col("waif_class").alias("id")).distinct()
    named = w.properties.filter(F.startswith("name", F.lit(":"))).select(F.col("oid").alias("ancestor_id"), "slot", F.expr("substring(name, 2)").alias("name"))
    j = ancestors(w, classes).join(named, "ancestor_id").withColumn("key", F.lower("name"))
    own = j.groupBy("id", "key").agg(F.max(F.struct("rank", "slot", "name")).alias("m")).select("id", "m.*")
    place = F.row_number().over(W.partitionBy("id").orderBy("rank", "slot", "name")) - 1
    return own.select(F.col("id").alias("waif_class"), place.alias("slot"), "name")


def slot_values(w: World, name: str | int) -> DataFrame:
    """``waif_index, waif_class, value_json`` of one slot of every waif, given by name or position.

    A slot a waif does not set shows its class's value of ``:name``, following cleared properties; a class without
    that slot, and a position that is not set, has null.
    """
    from dataclasses import replace

    from worldloom.operators.inherit import all_values

    every = w.waifs.select("waif_index", "waif_class").distinct()
    set_ = slots(w)
    if isinstance(name, int):
        mine = set_.filter(F.col("slot") == name).select("waif_index", "waif_class", F.col("value_json").alias("v"))
        return every.join(mine.groupBy("waif_index", "waif_class").agg(F.min("v").alias("value_json")), ["waif_index", "waif_class"], "left")
    wanted = name.lower()
    at = slot_names(w).filter(F.lower("name") == wanted).groupBy("waif_class").agg(F.min("slot").alias("slot"))
    mine = set_.join(at, ["waif_class", "slot"]).filter(tag() != "clear").groupBy("waif_index", "waif_class").agg(F.min("value_json").alias("v"))
    only = replace(w, properties=w.properties.filter(F.lower("name") == ":" + wanted))
    default = all_values(only).groupBy(F.col("oid").alias("waif_class")).agg(F.min("value_json").alias("d"))
    j = every.join(mine, ["waif_index", "waif_class"], "left").join(default.join(at.select("waif_class"), "waif_class"), "waif_class", "left")
    return j.select("waif_index", "waif_class", F.coalesce("v", "d").alias("value_json"))


def _strings(value: Column) -> Column:
    """The string a value is, or the strings its list holds."""
    items = F.from_json(F.get_json_object(value, "$.items"), "array<struct<type:string,value:string>>")
    inside = F.transform(F.filter(items, lambda x: x["type"] == "string"), lambda x: x["value"])
    return F.when(tag(value) == "string", F.array(F.get_json_object(value, "$.value"))).otherwise(F.coalesce(inside, F.array().cast("array<string>")))


def grouped(w: World, classes: DataFrame | None, by: list[tuple[str | int, bool]], where: list[tuple[str | int, str, bool]] = ()) -> DataFrame:
    """Waifs of ``classes(id)`` and their descendants, or of all classes, counted by class and slot values.

    ``by`` names slots, each with whether only the truth of its value counts; the columns are ``by_0``, ``by_1``...,
    a value in canonical spelling, ``true`` or ``false``, or ``none``.  Each ``where`` is slot, pattern, negate: the
    slot's string, or any string of its list, must match (must not).  Columns ``waif_class, by_0..., n_waifs``;
    each waif counts once, however often its row was delivered and wherever it is held.
    """
    from worldloom.functions.moo import truth
    from worldloom.functions.values import canonical
    from worldloom.operators.graph import below
    from worldloom.operators.inspect import scalar as content

    rows = w.waifs.select("waif_index", "waif_class").distinct()
    if classes is not None:
        down = w.objects.select(F.explode("parents").alias("src"), F.col("id").alias("dst")).filter("src IS NOT NULL")
        mine = below(down, classes.select(F.col("id").alias("root"))).select(F.col("id").alias("waif_class")).distinct()
        rows = rows.join(mine, "waif_class", "left_semi")
    for name, pattern, negate in where:
        hit = F.exists(_strings(F.col("value_json")), lambda x: x.rlike(pattern))
        v = slot_values(w, name).select("waif_index", "waif_class", F.coalesce(hit, F.lit(False)).alias("hit"))
        rows = rows.join(v.filter(F.col("hit") != F.lit(negate)).select("waif_index", "waif_class"), ["waif_index", "waif_class"], "left_semi")
    keys = []
    for i, (name, only_truth) in enumerate(by):
        v = F.col("value_json")
        members = F.coalesce(F.size(F.from_json(F.coalesce(F.get_json_object(v, "$.items"), F.get_json_object(v, "$.entries")), "array<string>")), F.lit(0))
        shown = F.when(truth(tag(v), content(v), members), "true").otherwise("false") if only_truth else canonical(v)
        got = slot_values(w, name).select("waif_index", "waif_class", F.when(v.isNull(), "none").otherwise(shown).alias(f"by_{i}"))
        rows = rows.join(got, ["waif_index", "waif_class"])
        keys.append(f"by_{i}")
    return rows.groupBy("waif_class", *keys).agg(F.count("*").alias("n_waifs"))


def holders(w: World) -> DataFrame:
    """``holder_id, waif_index``: objects whose values lead to a waif, directly or through other waifs."""
    direct = value_nodes(w).filter("tag = 'waif'").select(F.col("holder_id").alias("o"), F.col("scalar").try_cast("bigint").alias("waif_index"))
    rows = w.waifs.select(F.lit("waif").alias("holder_kind"), F.col("waif_index").alias("holder_id"), F.lit(None).cast("string").alias("member"), F.col("props").alias("text"))
    deep = nested.flatten_values(rows, "slots", linked=True).filter("tag = 'waif'").select(F.col("holder_id").alias("src"), F.col("scalar").try_cast("bigint").alias("dst"))
    top = slots(w).filter(tag() == "waif").select(F.col("waif_index").alias("src"), scalar().try_cast("bigint").alias("dst"))
    inner = deep.unionByName(top)
    return _closure(direct, inner.distinct())


def _closure(direct: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of holder and waif, followed along waif-to-waif links until a level finds nothing new."""
    seen = materialize(direct.select(F.col("o").alias("holder_id"), "waif_index").distinct(), "waif-holders-0")
    front, d = seen, 0
    while True:
        d += 1
        step = front.join(inner, front.waif_index == inner.src).select("holder_id", F.col("dst").alias("waif_index")).distinct()
        front = materialize(step.join(seen, ["holder_id", "waif_index"], "left_anti"), f"waif-front-{d}")
        if front.isEmpty():
            return seen
        seen = materialize(seen.union(front), f"waif-holders-{d}")
