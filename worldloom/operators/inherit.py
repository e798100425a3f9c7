"""Inheritance: ancestor order, verb dispatch, and effective values through cleared slots."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators.hierarchy import contract_forest
from worldloom.operators.inspect import World, aliases, tag
from worldloom.session import count_rows, materialize


def parent_links(w: World) -> DataFrame:
    """``c, pos, p``: parents that exist, in order; nulls are left out."""
    links = w.objects.select(F.col("id").alias("c"), F.posexplode("parents").alias("pos", "p")).filter("p IS NOT NULL")
    return materialize(links.join(w.objects.select(F.col("id").alias("p")), "p", "left_semi").select("c", "pos", "p"), "parent-links")


def ancestors(w: World, of: DataFrame | None = None) -> DataFrame:
    """``id, ancestor_id, rank``: every ancestor once, in depth-first order through the ordered parents.

    ``of`` names the objects asked about (``id``), else all.  Paths of parent positions are carried along; an
    ancestor's smallest path decides its rank, since a prefix sorts before its extensions.  An object reached again
    along one path is not followed, so cycles end.
    """
    real = parent_links(w)
    ids = w.objects.filter("id IS NOT NULL").select("id")
    start = (ids if of is None else ids.join(of.select("id").distinct(), "id", "left_semi")).select("id", F.col("id").alias("at"), F.array().cast("array<int>").alias("path"), F.array("id").alias("seen"))
    levels = [materialize(start, "ancestors-0")]
    while True:
        step = levels[-1].join(real, levels[-1].at == real.c).filter(~F.array_contains("seen", F.col("p"))).select("id", F.col("p").alias("at"), F.concat("path", F.array("pos")).alias("path"), F.concat("seen", F.array("p")).alias("seen"))
        # Only the smallest path to an ancestor on a level can matter for its rank.
        front = materialize(step.groupBy("id", "at").agg(F.min(F.struct("path", "seen")).alias("m")).select("id", "at", "m.path", "m.seen"), f"ancestors-{len(levels)}")
        if front.isEmpty():
            break
        levels.append(front)
    every = reduce(DataFrame.unionByName, levels).groupBy("id", "at").agg(F.min("path").alias("path"))
    return every.select("id", F.col("at").alias("ancestor_id"), (F.row_number().over(W.partitionBy("id").orderBy("path")) - 1).alias("rank"))


#: Edges between objects with several parents that one task may settle.
LOCAL_EDGES = 50_000


def first_holder(w: World, holders: DataFrame, local_edges: int = LOCAL_EDGES, links: DataFrame | None = None) -> DataFrame:
    """``id, oid``: for each object the first of ``holders(oid)`` among itself and its ancestors in depth-first order.

    Objects with one parent are contracted onto what they hang on: a holder, an object with several parents, or a
    root.  Then only objects with several parents are left to choose, and they see each other directly.  ``links``
    are the world's ``parent_links``, if known.
    """
    real = parent_links(w) if links is None else links
    held = materialize(holders.select(F.col("oid").alias("id")).distinct().join(w.objects.select("id"), "id", "left_semi"), "holders")
    one = real.select("c", "p").distinct().groupBy("c").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    plain = one.filter("n = 1 AND p <> c").select(F.col("c").alias("id"), "p").join(held, "id", "left_anti")
    links = materialize(w.objects.filter("id IS NOT NULL").select("id").join(plain, "id", "left"), "unary-links")
    stop = materialize(contract_forest(links).select("id", F.col("root_id").alias("stop")), "stops")
    several = one.filter("n > 1").select(F.col("c").alias("j")).join(held.withColumnRenamed("id", "j"), "j", "left_anti")
    edges = real.withColumnRenamed("c", "j").join(several, "j", "left_semi").join(stop.withColumnRenamed("id", "p"), "p").groupBy("j", "stop").agg(F.min("pos").alias("pos"))
    ends = held.select(F.col("id").alias("stop"), F.lit(True).alias("held"))
    edges = edges.join(ends, "stop", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    edges = materialize(edges.filter("held").unionByName(edges.filter("NOT held").join(several.withColumnRenamed("j", "stop"), "stop", "left_semi")).select("j", "pos", "stop", "held"), "junctions")
    if count_rows(edges) <= local_edges:
        chosen = edges.repartition(1).mapInPandas(_choose, "j bigint, oid bigint")
    else:
        chosen = _choose_in_rounds(w, edges, held)
    found = held.select(F.col("id").alias("stop"), F.col("id").alias("oid")).unionByName(chosen.select(F.col("j").alias("stop"), "oid"))
    return stop.join(found, "stop").select("id", "oid")


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First holder in depth-first order for each object with several parents; a bounded table in one task."""
    parts = list(batches)
    e = pd.concat(parts).sort_values(["j", "pos"]) if parts else pd.DataFrame({"j": [], "pos": [], "stop": [], "held": []})
    ways: dict[int, list[tuple[int, bool]]] = {}
    for j, stop, held in zip(e["j"].tolist(), e["stop"].tolist(), e["held"].tolist()):
        ways.setdefault(int(j), []).append((int(stop), bool(held)))
    done: dict[int, int | None] = {}
    moved = True
    while moved:  # without cycles each pass settles the objects whose first way is settled
        moved = False
        for j in [j for j in ways if j not in done]:
            for stop, held in ways[j]:
                got = stop if held else done.get(stop, ...) if stop in ways else None
                if got is ...:
                    break
                if got is not None:
                    done[j] = got
                    moved = True
                    break
            else:
                done[j] = None
                moved = True
    for j in [j for j in ways if j not in done]:  # cycles: the walk itself, each object once
        seen, todo, got = {j}, list(reversed(ways[j])), None
        while todo and got is None:
            stop, held = todo.pop()
            if held:
                got = stop
            elif stop not in seen:
                seen.add(stop)
                todo += reversed(ways.get(stop, []))
        done[j] = got
    rows = [(j, got) for j, got in done.items() if got is not None]
    yield pd.DataFrame(rows, columns=["j", "oid"]).astype("int64")


def _choose_in_rounds(w: World, edges: DataFrame, held: DataFrame) -> DataFrame:
    """As ``_choose`` for tables of any size; objects whose ways lie on cycles are walked one by one."""
    done: list[DataFrame] = []
    while True:
        best = edges.groupBy("j").agg(F.min_by(F.struct("stop", "held"), "pos").alias("b"))
        now = materialize(best.filter("b.held").select("j", F.col("b.stop").alias("oid")), f"chosen-{len(done)}")
        done.append(now)
        rest = edges.join(now.select("j"), "j", "left_anti")
        known = now.withColumnsRenamed({"j": "stop", "oid": "__oid"})
        rest = rest.join(known, "stop", "left").select("j", "pos", F.coalesce("__oid", "stop").alias("stop"), (F.col("held") | F.col("__oid").isNotNull()).alias("held"))
        alive = rest.select(F.col("j").alias("stop")).distinct()
        rest = rest.filter("held").unionByName(rest.filter("NOT held").join(alive, "stop", "left_semi"))
        edges = materialize(rest, f"ways-{len(done)}")
        if now.isEmpty():
            break
    left = edges.select(F.col("j").alias("id")).distinct()
    if not left.isEmpty():
        walked = ancestors(w, left).join(held.withColumnRenamed("id", "ancestor_id"), "ancestor_id", "left_semi")
        done.append(walked.groupBy(F.col("id").alias("j")).agg(F.min_by("ancestor_id", "rank").alias("oid")))
    return reduce(DataFrame.unionByName, done)


def dispatch(w: World, word: str) -> DataFrame:
    """Which verb answers ``word`` on each object: ``id, oid, verb``.

    The plain word is looked for on the object and all its ancestors, in depth-first order; only where none of them
    answers, ``:word``, the spelling of waif class verbs.  On one object the verb with the least index counts.
    """
    real = parent_links(w)

    def answering(spelled: str) -> DataFrame | None:
        v = aliases(w).filter(moo.answers("alias", F.lit(spelled)))
        v = materialize(v.groupBy("oid").agg(F.min(F.struct("verb_index", "verb")).alias("v")).select("oid", F.col("v.verb").alias("verb")), "answering")
        return None if v.isEmpty() else first_holder(w, v, links=real).join(v, "oid").select("id", "oid", "verb")

    with ThreadPoolExecutor(2) as pool:  # the two spellings do not depend on each other
        plain, waif = pool.map(answering, (word, ":" + word))
    if plain is None or waif is None:
        found = plain if waif is None else waif
        return found if found is not None else w.objects.select("id", F.col("id").alias("oid"), F.lit("").alias("verb")).limit(0)
    return plain.unionByName(waif.join(plain.select("id"), "id", "left_anti"))


def effective_values(w: World) -> DataFrame:
    """Values of cleared properties: ``oid, name, value_from, value_json, steps``.

    A cleared property takes the value of the first parent that holds a property of that name, in any case, and so
    on.  Where there is none, or the parents go round in a circle, the property stays unresolved and has a null
    ``value_from``.  The slots form a forest, which is contracted like any other; no slot meets all its ancestors.
    """
    numbered = w.properties.select(F.monotonically_increasing_id().alias("sid"), "oid", "name", F.lower("name").alias("key"), "slot", "value_json", F.coalesce(tag() == "clear", F.lit(False)).alias("clear"))
    slots = materialize(numbered, "slots")
    first = slots.groupBy(F.col("oid").alias("p"), "key").agg(F.min_by("sid", F.struct("slot", "name")).alias("psid"))
    cleared = slots.filter("clear").select("sid", "oid", "name", "key")
    up = cleared.join(parent_links(w), cleared.oid == F.col("c")).join(first, ["p", "key"]).groupBy("sid").agg(F.min_by("psid", "pos").alias("p"))
    links = materialize(slots.select(F.col("sid").alias("id")).join(up.withColumnRenamed("sid", "id"), "id", "left"), "slot-links")
    ends = contract_forest(links).filter("depth > 0").select(F.col("id").alias("sid"), "root_id", "depth")
    own = slots.filter("NOT clear").select(F.col("sid").alias("root_id"), F.col("oid").alias("value_from"), "value_json")
    got = ends.join(own, "root_id").select("sid", "value_from", "value_json", F.col("depth").alias("steps"))
    return cleared.join(got, "sid", "left").select("oid", "name", "value_from", "value_json", "steps")


def holders(w: World, name: str) -> DataFrame:
    """Objects that hold a property of that name: how many, and how many with a value of their own."""
    p = w.properties.filter(F.lower("name") == name.lower())
    return p.agg(F.count("*").alias("n_objects"), F.count_if(F.coalesce(tag() != "clear", F.lit(True))).alias("n_own"))


def all_values(w: World) -> DataFrame:
    """Every property with the value it shows: ``oid, name, value_json, value_from``; unresolved ones keep ``clear``."""
    own = w.properties.filter(F.coalesce(tag() != "clear", F.lit(True))).select("oid", "name", "value_json", F.col("oid").alias("value_from"))
    got = effective_values(w).select("oid", "name", F.coalesce("value_json", F.lit('{"type":"clear"}')).alias("value_json"), "value_from")
    return own.unionByName(got)


def resolve(w: World, refs: DataFrame) -> DataFrame:
    """``ref, id`` of references ``#N``, ``N``, ``$name`` and ``$a.b.c``; null where nothing is found.

    A name is looked up on #0, each further part on the object found so far, by shown values, in any case; there
    are as many steps as the longest reference has parts.
    """
    from worldloom.operators.inspect import scalar

    named = all_values(w).filter(tag() == "obj").select(F.col("oid").alias("at"), F.lower("name").alias("part"), scalar().try_cast("bigint").alias("to"))
    named = materialize(named.groupBy("at", "part").agg(F.min("to").alias("to")), "named")
    number = F.regexp_extract("ref", r"^#?(-?\d+)$", 1)
    todo = refs.select("ref").distinct().select("ref", F.when(number != "", number.try_cast("bigint")).alias("id"), F.when(F.col("ref").rlike(r"^\$\w"), F.split(F.lower(F.expr("substring(ref, 2)")), r"\.")).alias("parts"))
    state = todo.select("ref", F.when(F.col("parts").isNull(), F.col("id")).otherwise(F.lit(0)).alias("at"), F.coalesce("parts", F.array().cast("array<string>")).alias("parts"))
    steps = refs.agg(F.coalesce(F.max(F.size(F.split("ref", r"\."))), F.lit(0))).collect()[0][0]
    for i in range(steps):
        s = state.withColumn("part", F.get("parts", F.lit(i)))
        j = s.join(named, ["at", "part"], "left")
        state = materialize(j.select("ref", F.when(F.col("part").isNull(), F.col("at")).otherwise(F.col("to")).alias("at"), "parts"), f"resolve-{i}")
    ids = w.objects.select(F.col("id").alias("at"), F.lit(1).alias("there"))
    return state.join(ids, "at", "left").select("ref", F.when(F.col("there") == 1, F.col("at")).alias("id"))
