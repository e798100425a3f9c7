"""Search, projection and census operators over one dump of a world.

``World`` holds the dump's records, one per key.  Every operator is a DataFrame plan; nothing is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.functions.values import canonical, value_hash
from worldloom.operators import nested
from worldloom.sources.tables import MEMBER_KEY, OBJECT_KEY, latest, live_dumps, table


@dataclass(frozen=True)
class World:
    """Records of one dump: ``objects``, ``properties``, ``verbs``, and the waifs."""

    objects: DataFrame
    properties: DataFrame
    verbs: DataFrame
    waifs: DataFrame


def open_world(spark: SparkSession, sf: str, back: int = 0) -> World:
    """The newest live dump, or the one ``back`` dumps before it; superseded deliveries are dropped."""
    dumps = live_dumps(table(spark, sf, "moo_dumps"))
    dump = dumps[-1 - back] if back < len(dumps) else None

    def rows(name: str, key: tuple[str, ...], cols: list[str]) -> DataFrame:
        t = table(spark, sf, name).filter(F.col("snapshot_id") == dump)
        return latest(t, key, cols).drop("snapshot_id")

    return World(
        rows("moo_objects", OBJECT_KEY, ["name", "flags", "owner", "location", "parents", "children", "contents", "last_move", "anon"]),
        rows("moo_properties", MEMBER_KEY, ["slot", "owner", "perms", "value_json"]),
        rows("moo_verbs", MEMBER_KEY, ["verb_index", "owner", "perms", "preps", "code"]),
        table(spark, sf, "moo_waifs").distinct(),
    )


def tag(value_json: Column | str = "value_json") -> Column:
    """The kind of a typed value."""
    return F.get_json_object(value_json, "$.type")


def scalar(value_json: Column | str = "value_json") -> Column:
    """The content of a scalar value: ``value``, or ``bits`` of a float."""
    return F.coalesce(F.get_json_object(value_json, "$.value"), F.get_json_object(value_json, "$.bits"))


def headers(w: World) -> DataFrame:
    """One row per object with decoded flags and the sizes of its lists and tables."""
    props = w.properties.groupBy("oid").agg(F.count("*").alias("n_properties"))
    verbs = w.verbs.groupBy("oid").agg(F.count("*").alias("n_verbs"))
    base = w.objects.select("id", "name", moo.flag_words("flags").alias("flag_words"), "owner", "location", *[F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}") for c in ("parents", "children", "contents")])
    out = base.join(props.withColumnRenamed("oid", "id"), "id", "left").join(verbs.withColumnRenamed("oid", "id"), "id", "left")
    return out.fillna(0, ["n_properties", "n_verbs"])


def builtins(w: World) -> DataFrame:
    """Built-in properties as rows: ``oid, name, value``."""
    o = w.objects
    pairs = [("name", F.col("name")), ("owner", F.col("owner").cast("string")), ("location", F.col("location").cast("string"))]
    pairs += [(n, moo.has_flag("flags", f).cast("int").cast("string")) for n, f in (("programmer", "programmer"), ("wizard", "wizard"), ("r", "readable"), ("w", "writable"), ("f", "fertile"))]
    return o.select(F.col("id").alias("oid"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])).alias("b")).select("oid", "b.name", "b.value")


def code_lines(w: World, code_only: bool = False) -> DataFrame:
    """``oid, verb_index, verb, line_no, line, seen``; an absent program has no lines.

    ``seen`` is what a search looks at: the line, or with ``code_only`` the line with string literals blanked.
    """
    pairs = F.arrays_zip(F.col("code").alias("line"), (moo.masked("code") if code_only else F.col("code")).alias("seen"))
    v = w.verbs.select("oid", "verb_index", F.col("name").alias("verb"), F.col("owner").alias("verb_owner"), "perms", F.posexplode(pairs).alias("p", "z"))
    return v.select("oid", "verb_index", "verb", "verb_owner", "perms", (F.col("p") + 1).alias("line_no"), F.col("z.line").alias("line"), F.col("z.seen").alias("seen"))


def grep(w: World, pattern: str, require: list[str] = (), exclude: list[str] = (), code_only: bool = False, wizard_owned: bool = False, executable: bool = False, verb: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Code lines that match ``pattern``.

    ``require`` must each hit some line of the verb, ``exclude`` none; with ``code_only`` string literals are
    blanked before matching.  ``verb`` keeps the verbs that answer to a word.  The original line is returned.
    """
    flags = "(?i)" if ignore_case else ""
    code = moo.masked("code") if code_only else F.col("code")
    v = w.verbs
    if executable:
        v = v.filter(F.col("perms").bitwiseAND(4) != 0)
    for p in require:
        v = v.filter(F.exists(code, lambda x: x.rlike(flags + p)))
    for p in exclude:
        v = v.filter(~F.coalesce(F.exists(code, lambda x: x.rlike(flags + p)), F.lit(False)))
    if wizard_owned:
        wizards = w.objects.filter(moo.has_flag("flags", "wizard")).select(F.col("id").alias("owner"))
        v = v.join(wizards, "owner", "left_semi")
    if verb is not None:
        names = F.filter(F.split("name", " +"), lambda x: x != "")
        v = v.filter(F.exists(names, lambda a: moo.answers(a, F.lit(verb)) | moo.answers(a, F.lit(":" + verb))))
    lines = code_lines(World(w.objects, w.properties, v, w.waifs), code_only)
    return lines.filter(F.col("seen").rlike(flags + pattern)).drop("seen")


def grep_summary(hits: DataFrame, by: str = "oid") -> DataFrame:
    """Lines and distinct verbs per object, or by the verbs' owner with ``by="verb_owner"``."""
    return hits.groupBy(by).agg(F.count("*").alias("n_lines"), F.count_distinct("oid", "verb_index", "verb").alias("n_verbs"))


def grep_page(hits: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of the verbs that have hits, by object and index, with the counts over all pages.

    Columns ``oid, verb_index, verb, n_lines, total_lines, total, next_offset``.
    """
    from worldloom.operators.joins import page

    per = hits.groupBy("oid", "verb_index", "verb").agg(F.count("*").alias("n_lines"))
    lines = per.agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("total_lines"))
    return page(per.crossJoin(F.broadcast(lines)), ["oid", "verb_index", "verb"], offset, size)


def grep_context(w: World, pattern: str, n: int) -> DataFrame:
    """Matching lines with ``n`` lines around, and whether a line opens a new block."""
    by = W.partitionBy("oid", "verb").orderBy("line_no")
    near = code_lines(w).drop("seen").withColumn("hit", F.col("line").rlike(pattern)).withColumn("near", F.max(F.col("hit").cast("int")).over(by.rowsBetween(-n, n)))
    kept = near.filter("near = 1").withColumn("opens", F.coalesce(F.col("line_no") - F.lag("line_no").over(by) > 1, F.lit(True)))
    return kept.select("oid", "verb", "line_no", "line", F.col("hit").cast("int").alias("hit"), F.col("opens").cast("int").alias("opens"))


def without_match(w: World, pattern: str) -> DataFrame:
    """Verbs that have a program none of whose lines matches."""
    return w.verbs.filter((F.size("code") > 0) & ~F.exists("code", lambda x: x.rlike(pattern))).select("oid", "name")


def aliases(w: World) -> DataFrame:
    """``oid, verb_index, verb, alias``: a verb's names one by one."""
    return w.verbs.select("oid", "verb_index", F.col("name").alias("verb"), "perms", "preps", F.explode(F.filter(F.split("name", " +"), lambda x: x != "")).alias("alias"))


def verbs_answering(w: World, word: str, catch_alls: bool = True) -> DataFrame:
    """Verbs that answer a call of ``word``, in plain spelling or as ``:word``."""
    a = aliases(w)
    hit = moo.answers("alias", F.lit(word)) | moo.answers("alias", F.lit(":" + word))
    if not catch_alls:
        hit = hit & ~moo.catch_all("alias")
    return a.filter(hit).select("oid", "verb", "alias").distinct()


def commands(w: World) -> DataFrame:
    """Verbs a player can type (arguments other than this none this) with their leading comment lines."""
    comment = r'^\s*".*";\s*$'
    first = F.array_min(F.transform(F.sequence(F.lit(1), F.size("code") + 1), lambda i: F.when((i > F.size("code")) | ~F.coalesce(F.get(F.col("code"), i - 1).rlike(comment), F.lit(False)), i)))
    args = moo.verb_args("perms", "preps")
    n = F.when(F.coalesce(F.size("code"), F.lit(0)) > 0, first - 1).otherwise(0)
    return w.verbs.filter(args != "this none this").select("oid", "name", args.alias("args"), F.coalesce(n, F.lit(0)).alias("n_comment_lines"))


def stored(w: World) -> DataFrame:
    """Properties that hold a value of their own."""
    return w.properties.filter(F.coalesce(tag() != "clear", F.lit(True)))


def value_nodes(w: World) -> DataFrame:
    """All nodes below the top of all property values, with scalars; the heart of reference and string search."""
    p = w.properties.select(F.lit("property").alias("holder_kind"), F.col("oid").alias("holder_id"), F.col("name").alias("member"), F.col("value_json").alias("text"))
    deep = nested.flatten_values(p.filter(F.col("text").contains("[")), "value", linked=True)
    top = p.filter(F.col("text").isNotNull()).select("holder_kind", "holder_id", "member", F.lit("").alias("path"), tag("text").alias("tag"), F.lit(None).cast("string").alias("parent_path"), scalar("text").alias("scalar"))
    return top.unionByName(deep)


def references(w: World, targets: DataFrame | None = None) -> DataFrame:
    """Object numbers in stored values: ``target, holder_id, member, path``; ``targets(id)`` narrows them."""
    r = value_nodes(w).filter("tag = 'obj'").select(F.col("scalar").try_cast("bigint").alias("target"), "holder_id", "member", "path")
    return r.join(targets.select(F.col("id").alias("target")), "target", "left_semi") if targets is not None else r


def code_mentions(w: World, code_only: bool = False) -> DataFrame:
    """``#N`` in code, existing objects only: ``target, oid, verb, line_no`` once per line."""
    hit = code_lines(w, code_only).select("oid", "verb", "line_no", F.explode(F.regexp_extract_all("seen", F.lit(r"(?<![\w#$-])#(\d+)(?!\d)"), F.lit(1))).alias("n"))
    return hit.select(F.col("n").try_cast("bigint").alias("target"), "oid", "verb", "line_no").distinct().join(w.objects.select(F.col("id").alias("target")), "target", "left_semi")


def census(w: World, by: str) -> DataFrame:
    """Objects per owner, location or first parent: count, code bytes and the three lowest numbers."""
    key = F.get("parents", F.lit(0)) if by == "parent" else F.col(by)
    size = w.verbs.groupBy("oid").agg(F.sum(F.coalesce(F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1), F.lit(0))).alias("bytes")).withColumnRenamed("oid", "id")
    o = w.objects.select("id", key.alias("key")).join(size, "id", "left").fillna(0, ["bytes"])
    small = o.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("id")))
    # The three examples come from a window that keeps three rows a group, so no group's ids are gathered.
    ex = small.filter("r <= 3").groupBy("key").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string"))).alias("examples"))
    sums = o.groupBy("key").agg(F.count("*").alias("n_objects"), F.sum("bytes").alias("bytes"))
    return sums.join(ex, sums.key.eqNullSafe(ex.key)).select(sums.key, "n_objects", "bytes", "examples")


def number_slots(w: World) -> DataFrame:
    """Every place that holds an object number: ``kind, field, holder, number``."""
    o = w.objects
    one = lambda c: o.select(F.lit("object").alias("kind"), F.lit(c).alias("field"), F.col("id").alias("holder"), F.col(c).alias("number"))
    many = lambda c: o.select(F.lit("object").alias("kind"), F.lit(c).alias("field"), F.col("id").alias("holder"), F.explode(c).alias("number"))
    parts = [one("owner"), one("location"), many("parents"), many("children"), many("contents")]
    parts.append(w.properties.select(F.lit("property").alias("kind"), F.lit("owner").alias("field"), F.col("oid").alias("holder"), F.col("owner").alias("number")))
    parts.append(w.verbs.select(F.lit("verb").alias("kind"), F.lit("owner").alias("field"), F.col("oid").alias("holder"), F.col("owner").alias("number")))
    parts.append(references(w).select(F.lit("property").alias("kind"), F.lit("value").alias("field"), F.col("holder_id").alias("holder"), F.col("target").alias("number")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("number IS NOT NULL")


def slot_totals(w: World) -> DataFrame:
    """Number slots by kind and field: total, negative, missing (non-negative numbers that are no object)."""
    ids = w.objects.select(F.col("id").alias("number"), F.lit(1).alias("there"))
    s = number_slots(w).join(ids, "number", "left")
    return s.groupBy("kind", "field").agg(F.count("*").alias("n_slots"), F.count_if(F.col("number") < 0).alias("n_negative"), F.count_if((F.col("number") >= 0) & F.col("there").isNull()).alias("n_missing"))


def key_kinds(w: World) -> DataFrame:
    """Kinds of the keys of all maps."""
    return value_nodes(w).filter(F.col("path").rlike(r":key$")).groupBy("tag").agg(F.count("*").alias("n_keys"))


def largest_values(w: World, n: int) -> DataFrame:
    """The ``n`` longest stored values in canonical spelling, ties by object and name: a top-k report."""
    v = stored(w).select("oid", "name", F.length(canonical("value_json")).cast("bigint").alias("size"))
    return v.orderBy(F.desc("size"), "oid", "name").limit(n)


def same_values(w: World) -> DataFrame:
    """Stored values grouped by name and typed value: how many objects share them."""
    v = stored(w).filter("value_json IS NOT NULL").select("oid", F.lower("name").alias("name"), value_hash("value_json").alias("h"))
    return v.groupBy("name", "h").agg(F.count("*").alias("n"), F.min("oid").alias("first_oid")).filter("n > 1").select("name", "n", "first_oid")


def dollar_names(w: World, of: int | None = 0) -> DataFrame:
    """Objects named by #0's properties: ``oid, target, dollar_name``; the first such property wins.

    ``of`` is another object whose properties name, or None for what each object's properties name.
    """
    p = w.properties.filter(tag() == "obj").select("oid", scalar().try_cast("bigint").alias("target"), "slot", "name")
    if of is not None:
        p = p.filter(F.col("oid") == of)
    return p.groupBy("oid", "target").agg(F.min(F.struct("slot", "name")).alias("s")).select("oid", "target", F.col("s.name").alias("dollar_name"))


def waif_counts(w: World) -> DataFrame:
    """Waifs by class with the class's name and how many have unreadable or no props."""
    names = w.objects.select(F.col("id").alias("waif_class"), F.col("name").alias("class_name"))
    g = w.waifs.groupBy("waif_class").agg(F.count("*").alias("n_waifs"), F.count_if(F.col("props").isNull()).alias("n_without_props"))
    return g.join(names, "waif_class", "left")


def players(w: World) -> DataFrame:
    """Players with whether their owner and location still exist."""
    ids = w.objects.select("id")
    p = w.objects.filter(moo.has_flag("flags", "player")).select("id", "name", "owner", "location")
    mark = lambda d, c: d.join(ids.select(F.col("id").alias(c), F.lit(1).alias(f"{c}_there")), c, "left")
    return mark(mark(p, "owner"), "location").select("id", "name", F.coalesce("owner_there", F.lit(0)).alias("owner_there"), F.coalesce("location_there", F.lit(0)).alias("location_there"))


def string_mentions(w: World) -> DataFrame:
    """``#N`` of existing objects in stored strings: ``target, holder_id, member, n``."""
    s = value_nodes(w).filter("tag = 'string'").select("holder_id", "member", F.explode(F.regexp_extract_all("scalar", F.lit(r"#(\d+)"), F.lit(1))).alias("n"))
    hit = s.select(F.col("n").try_cast("bigint").alias("target"), "holder_id", "member").join(w.objects.select(F.col("id").alias("target")), "target", "left_semi")
    return hit.groupBy("target", "holder_id", "member").agg(F.count("*").alias("n"))


def missing_by(w: World, by: str = "holder") -> DataFrame:
    """Slots whose number is no object, counted by ``holder`` or by ``number``."""
    s = number_slots(w).filter("number >= 0").join(w.objects.select(F.col("id").alias("number")), "number", "left_anti")
    return s.groupBy(by).agg(F.count("*").alias("n_missing"))


def chosen(w: World, ids: list[int] = (), owned_by: int | None = None, name_pattern: str | None = None) -> DataFrame:
    """``id`` of objects given by number, by owner, or by a pattern of their name."""
    hit = F.col("id").isin(list(ids))
    if owned_by is not None:
        hit = hit | F.coalesce(F.col("owner") == owned_by, F.lit(False))
    if name_pattern is not None:
        hit = hit | F.coalesce(F.col("name").rlike(name_pattern), F.lit(False))
    return w.objects.filter(hit).select("id")
