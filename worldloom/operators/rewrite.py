"""Rewriting a world: dense renumbering, dead references, reassignment, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.operators.inspect import World
from worldloom.operators.joins import dense_numbers
from worldloom.session import materialize


def renumbering(w: World, gone: DataFrame, keep_numbers: bool = False) -> DataFrame:
    """``id, new_id``: surviving objects numbered densely in order of their numbers, or as they were with ``keep_numbers``."""
    stay = w.objects.filter("id >= 0").select("id").join(gone.select("id"), "id", "left_anti")
    return stay.withColumn("new_id", F.col("id")) if keep_numbers else dense_numbers(stay, "id", "new_id")


def dead_base(w: World) -> DataFrame:
    """One row ``base``: references to removed numbers become ``base - old``, below every number in use."""
    low = w.objects.agg(F.min(F.least("id", "owner", "location")).alias("m"))
    return low.select(F.least(F.lit(-1_000_000).cast("bigint"), F.col("m") - 1).alias("base"))


def _mapped(old: Column, new: Column, base: Column) -> Column:
    """Negative numbers stay, known ones get their new number, the rest become dead references."""
    return F.when(old.isNull() | (old < 0), old).otherwise(F.coalesce(new, base - old))


def _owner(d: DataFrame, gone: DataFrame, owner_to: int | None) -> DataFrame:
    """What removed owners held goes to ``owner_to``, if given."""
    if owner_to is None:
        return d
    lost = gone.select(F.col("id").alias("owner"), F.lit(1).alias("__lost")).distinct()
    return d.join(lost, "owner", "left").withColumn("owner", F.when(F.col("__lost") == 1, F.lit(owner_to).cast("bigint")).otherwise(F.col("owner"))).drop("__lost")


def _renamed(d: DataFrame, ids: DataFrame, base: DataFrame, column: str) -> DataFrame:
    j = d.join(ids.withColumnsRenamed({"id": column, "new_id": "__new"}), column, "left").crossJoin(F.broadcast(base))
    return j.withColumn(column, _mapped(F.col(column), F.col("__new"), F.col("base"))).drop("__new", "base")


def renumbered(w: World, gone: DataFrame, owner_to: int | None = None, keep_numbers: bool = False) -> DataFrame:
    """Objects that stay, with every number rewritten: ``id, name, owner, location, parents, children, contents``.

    ``owner_to`` takes over what removed owners held.  List order and repeats are kept; removed objects leave the
    children and contents, in parents they become dead references.
    """
    ids = materialize(renumbering(w, gone, keep_numbers), "renumbering")
    base = dead_base(w)
    o = _owner(w.objects, gone, owner_to).join(ids, "id")
    for c in ("owner", "location"):
        o = _renamed(o, ids, base, c)
    lost = gone.select(F.col("id").alias("n"), F.lit(1).alias("lost")).distinct()
    for c in ("parents", "children", "contents"):
        links = w.objects.select("id", F.posexplode(c).alias("i", "n"))
        if c != "parents":
            links = links.join(lost, "n", "left").filter("lost IS NULL").drop("lost")
        lists = _renamed(links, ids, base, "n").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("__l"))
        o = o.join(lists, "id", "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col("__l.n"), F.array().cast("array<bigint>")))).drop("__l")
    return o.select(F.col("new_id").alias("id"), "name", "owner", "location", "parents", "children", "contents")


def renumbered_members(w: World, gone: DataFrame, kind: str = "properties", owner_to: int | None = None, keep_numbers: bool = False) -> DataFrame:
    """Properties or verbs of the objects that stay under their new numbers, owners rewritten: ``oid, name, owner``."""
    ids = materialize(renumbering(w, gone, keep_numbers), "renumbering")
    d = _owner(getattr(w, kind).select("oid", "name", "owner"), gone, owner_to)
    d = d.join(ids.withColumnRenamed("id", "oid"), "oid").drop("oid").withColumnRenamed("new_id", "oid")
    return _renamed(d, ids, dead_base(w), "owner").select("oid", "name", "owner")


def renumbered_values(w: World, ids: DataFrame, base: int) -> DataFrame:
    """``oid, name, value_json`` with every object number rewritten by ``ids(id, new_id)``; unknown ones become ``base - N``.

    Negative numbers stay, and so does the spelling of all else.  A value gets only the map of the numbers it holds.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from worldloom.operators.inspect import references
    from worldloom.operators.nested import scalar_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            text, begin, stop, _ = scalar_spans(texts, "obj")
            out = texts.to_pylist()
            known = [dict(x) if x is not None else {} for x in b.column(3).to_pylist()]
            for i in np.unique(text).tolist():
                raw = out[i].encode()
                for a, z in sorted(zip(begin[text == i].tolist(), stop[text == i].tolist()), reverse=True):
                    n = int(raw[a:z].strip(b'"'))
                    if n >= 0:
                        new = str(known[i].get(n, base - n)).encode()
                        raw = raw[:a] + (b'"' + new + b'"' if raw[a : a + 1] == b'"' else new) + raw[z:]
                out[i] = raw.decode()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["oid", "name", "value_json"])

    held = references(w).select(F.col("holder_id").alias("oid"), F.col("member").alias("name"), F.col("target").alias("id")).distinct()
    maps = held.join(ids.select("id", "new_id"), "id").groupBy("oid", "name").agg(F.map_from_entries(F.collect_list(F.struct("id", "new_id"))).alias("known"))
    return w.properties.select("oid", "name", "value_json").join(maps, ["oid", "name"], "left").mapInArrow(run, "oid bigint, name string, value_json string")


def redacted(events: DataFrame, protected: DataFrame, key: str = "oid") -> DataFrame:
    """Events of protected objects folded into one marker row each; all others as they are.

    ``protected(key)``; the markers tell that something changed, not what or how much.
    """
    mark = protected.select(key).distinct().withColumn("__p", F.lit(1))
    e = events.join(mark, key, "left")
    others = [c for c in events.columns if c != key]
    shown = e.filter("__p IS NULL").select(*events.columns)
    hidden = e.filter("__p = 1").select(key).distinct().select(key, *[F.lit("redacted").cast(events.schema[c].dataType).alias(c) for c in others])
    return shown.unionByName(hidden.select(*events.columns))


def reassigned(w: World, from_owner: int, to: int) -> DataFrame:
    """How many objects, properties and verbs would change owner: ``kind, n``."""
    parts = [(k, d) for k, d in (("object", w.objects), ("property", w.properties), ("verb", w.verbs))]
    out = None
    for k, d in parts:
        c = d.agg(F.count_if(F.col("owner") == from_owner).alias("n")).select(F.lit(k).alias("kind"), "n", F.lit(to).cast("bigint").alias("new_owner"))
        out = c if out is None else out.unionByName(c)
    return out


def renumbered_code(w: World, ids: DataFrame, base: int) -> DataFrame:
    """``oid, name, code`` with every ``#N`` outside strings rewritten by ``ids(id, new_id)``; unknown ones become ``base - N``.

    A verb gets only the map of the numbers it names, so the Python step sees one small map per program.
    """
    from collections.abc import Iterator

    import pandas as pd

    from worldloom.functions import moo
    from worldloom.operators.inspect import code_lines

    pattern = r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\Z)|(?<![\w#$-])#(\d+)(?!\d)'

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        number = re.compile(pattern)
        for b in batches:
            codes = []
            for code, pairs in zip(b["code"], b["pairs"]):
                known = {} if pairs is None else {p["id"]: p["new_id"] for p in pairs}

                def one(m: re.Match, known: dict = known) -> str:
                    return m.group() if m.group(1) is None else f"#{known.get(int(m.group(1)), base - int(m.group(1)))}"

                # Strings may run over several lines, so the program is rewritten as one text.
                lines = number.sub(one, "\n".join(x or "" for x in code)).split("\n") if len(code) else []
                codes.append([None if was is None else x for was, x in zip(code, lines)])
            yield pd.DataFrame({"oid": b["oid"], "name": b["name"], "code": codes})

    seen = code_lines(w, True).select("oid", F.col("verb").alias("name"), F.explode(F.regexp_extract_all("seen", F.lit(r"(?<![\w#$-])#(\d+)(?!\d)"), F.lit(1))).alias("n")).select("oid", "name", F.col("n").try_cast("bigint").alias("id")).distinct()
    pairs = seen.join(ids.select("id", "new_id"), "id").groupBy("oid", "name").agg(F.collect_list(F.struct("id", "new_id")).alias("pairs"))
    v = w.verbs.filter("code IS NOT NULL").select("oid", "name", "code").join(pairs, ["oid", "name"], "left")
    return v.mapInPandas(run, "oid bigint, name string, code array<string>")


def without_dead(w: World, gone: DataFrame, field: str = "contents") -> DataFrame:
    """``id, {field}``: lists without removed numbers, order kept; null lists stay null."""
    links = w.objects.select("id", F.posexplode_outer(field).alias("i", "n"))
    lost = gone.select(F.col("id").alias("n"), F.lit(1).alias("lost"))
    kept = links.join(lost, "n", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("lost").isNull() & F.col("i").isNotNull(), F.struct("i", "n")))).alias("x"))
    return w.objects.select("id", F.col(field).isNull().alias("__null")).join(kept, "id", "left").select("id", F.when(~F.col("__null"), F.col("x.n")).alias(field))


def emptied(w: World, oid: int, name: str) -> DataFrame:
    """Properties with the value of one property emptied: strings, lists and maps become empty, other values zero."""
    from worldloom.operators.inspect import tag

    empty = F.when(tag() == "string", '{"type":"string","value":""}').when(tag() == "list", '{"items":[],"type":"list"}').when(tag() == "map", '{"entries":[],"type":"map"}').otherwise('{"type":"int","value":"0"}')
    hit = (F.col("oid") == oid) & (F.lower("name") == name.lower()) & F.coalesce(tag() != "clear", F.lit(False))
    return w.properties.withColumn("value_json", F.when(hit, empty).otherwise(F.col("value_json")))
