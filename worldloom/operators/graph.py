"""The relationship graph of a dump and its searches: level loops over edge tables, written out per level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.operators.hierarchy import contract_forest, first_existing_parent
from worldloom.operators.inspect import World, references
from worldloom.session import materialize


def edges(w: World) -> DataFrame:
    """``src, dst, kind, evidence``: owner, location, parent, child, content and property edges of all objects."""
    o = w.objects
    one = lambda c: o.filter(F.col(c).isNotNull()).select(F.col("id").alias("src"), F.col(c).alias("dst"), F.lit(c).alias("kind"), F.lit("").alias("evidence"))

    def many(c: str, kind: str) -> DataFrame:
        return o.select(F.col("id").alias("src"), F.posexplode(c).alias("i", "dst")).filter("dst IS NOT NULL").select("src", "dst", F.lit(kind).alias("kind"), (F.col("i") + 1).cast("string").alias("evidence"))

    held = references(w).select(F.col("holder_id").alias("src"), F.col("target").alias("dst"), F.lit("property").alias("kind"), F.concat_ws(":", "member", "path").alias("evidence"))
    return reduce(DataFrame.unionByName, [one("owner"), one("location"), many("parents", "parent"), many("children", "child"), many("contents", "content"), held])


def status(w: World, e: DataFrame) -> DataFrame:
    """Edges with what their target is: ``object``, ``special`` (negative numbers) or ``dangling``."""
    ids = w.objects.select(F.col("id").alias("dst"), F.lit(1).alias("there"))
    return e.join(ids, "dst", "left").withColumn("status", F.when(F.col("dst") < 0, "special").when(F.col("there").isNull(), "dangling").otherwise("object")).drop("there")


def neighbourhood(e: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``id, depth``: nodes reached from ``roots(id)`` along ``e(src, dst)``, with the least number of steps.

    Without a depth bound the loop ends when a level reaches nothing new, so cycles are harmless.
    """
    links = materialize(e.select("src", "dst").distinct(), "graph-links")
    front = materialize(roots.select("id").distinct().withColumn("depth", F.lit(0)), "reach-0")
    seen = [front]
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        step = front.join(links, front.id == links.src).select(F.col("dst").alias("id")).distinct()
        front = materialize(step.join(reduce(DataFrame.unionByName, seen), "id", "left_anti").withColumn("depth", F.lit(d)), f"reach-{d}")
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > 8:  # a level reads a few tables, not one per level before it
            seen = [materialize(reduce(DataFrame.unionByName, seen), f"reached-{d}")]
    return reduce(DataFrame.unionByName, seen)


def shortest_paths(e: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``id, depth, path`` within ``max_depth`` steps: the path through the smallest predecessors, as ``a/b/c``."""
    links = materialize(e.select("src", "dst").distinct(), "path-links")
    seen = [materialize(roots.select("id").distinct().select("id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path"), F.array("id").alias("via")), "paths-0")]
    for d in range(1, max_depth + 1):
        step = seen[-1].join(links, seen[-1].id == links.src).select(F.col("dst").alias("id"), F.struct(F.concat("via", F.array("dst")).alias("via"), F.concat_ws("/", "path", F.col("dst").cast("string")).alias("path")).alias("m"))
        new = step.join(reduce(DataFrame.unionByName, seen), "id", "left_anti").groupBy("id").agg(F.min("m").alias("m"))
        fresh = materialize(new.select("id", F.lit(d).alias("depth"), "m.path", "m.via"), f"paths-{d}")
        if fresh.isEmpty():
            break
        seen.append(fresh)
    return reduce(DataFrame.unionByName, seen).select("id", "depth", "path")


def below(e: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``root, id, depth``: for each of ``roots(root)`` the objects reached along ``e(src, dst)``, by their least distance.

    The root itself has distance 0; ``max_depth`` bounds the distance.  As many rows as the result holds; no root's objects are gathered.
    """
    links = materialize(e.select("src", "dst").distinct(), "below-links")
    front = materialize(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct(), "below-0")
    seen, d = [front], 0
    while max_depth is None or d < max_depth:
        d += 1
        step = front.join(links, front.id == links.src).select("root", F.col("dst").alias("id")).distinct()
        front = materialize(step.join(reduce(DataFrame.unionByName, seen), ["root", "id"], "left_anti").withColumn("depth", F.lit(d)), f"below-{d}")
        if front.isEmpty():
            break
        seen.append(front)
        if len(seen) > 8:
            seen = [materialize(reduce(DataFrame.unionByName, seen), f"below-all-{d}")]
    return reduce(DataFrame.unionByName, seen)


def tree_summary(w: World, field: str = "children", roots: DataFrame | None = None) -> DataFrame:
    """What hangs below each of ``roots(root)``, or below every object, along ``children`` or ``contents``.

    Columns ``root, n_direct, n_descendants, n_leaves, max_depth, n_missing, n_repeated``.  The root is not counted;
    depths are least distances; a leaf has no stored links.  Missing and repeated links are counted over all objects
    visited: of the links to existing objects one found each descendant, the others repeat.  Null links are ignored.
    """
    if field not in ("children", "contents"):
        raise ValueError(f"not a tree relation: {field!r}")
    ids = w.objects.filter("id IS NOT NULL").select("id")
    stored = w.objects.filter("id IS NOT NULL").select(F.col("id").alias("src"), F.explode(F.filter(field, lambda x: x.isNotNull())).alias("dst"))
    links = materialize(stored.join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("there")), "dst", "left"), "tree-links")
    real = links.filter("there = 1")
    reached = below(real, ids.withColumnRenamed("id", "root") if roots is None else roots.join(ids.withColumnRenamed("id", "root"), "root", "left_semi"))
    per = links.groupBy(F.col("src").alias("id")).agg(F.count("there").alias("real"), F.count_if(F.col("there").isNull()).alias("missing"))
    j = reached.join(per, "id", "left")
    under = F.col("depth") > 0
    return j.groupBy("root").agg(
        F.count_if(F.col("depth") == 1).alias("n_direct"),
        F.count_if(under).alias("n_descendants"),
        F.count_if(under & F.col("real").isNull()).alias("n_leaves"),
        F.max("depth").alias("max_depth"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("n_missing"),
        (F.coalesce(F.sum("real"), F.lit(0)) - F.count_if(under)).alias("n_repeated"),
    )


def outermost(w: World) -> DataFrame:
    """``id, top``: the outermost location of each object; itself where it is nowhere.

    A location that does not exist ends the walk; in a circle of locations there is no top and ``top`` is null.
    Containment is a forest like inheritance, so tree contraction answers it.
    """
    one = w.objects.select("id", F.array("location").alias("parents"))
    tops = contract_forest(materialize(first_existing_parent(one), "places"))
    return tops.select("id", F.when(F.col("depth") >= 0, F.col("root_id")).alias("top"))


def unreachable(w: World, kinds: tuple[str, ...] = ("parent", "location", "content", "property")) -> DataFrame:
    """Objects not reached from #0 and the players along the given kinds of edges (mark and sweep)."""
    from worldloom.functions import moo

    roots = w.objects.filter((F.col("id") == 0) | moo.has_flag("flags", "player")).select("id")
    e = edges(w).filter(F.col("kind").isin(*kinds))
    return w.objects.select("id", "owner").join(neighbourhood(e, roots), "id", "left_anti")


#: Properties whose values are bookkeeping lists; entries that name a removed object are dropped.
SET_LISTS = ("owned_objects", "lost_souls")


def created(w: World, name: str = "creation_time") -> DataFrame:
    """``id, made``: when objects were made, by a whole number of their own in the property; others are unknown."""
    from worldloom.operators.inspect import scalar, tag

    p = w.properties.filter((F.lower("name") == name) & (tag() == "int")).select(F.col("oid").alias("id"), scalar().try_cast("bigint").alias("made"))
    return p.filter("made <> 0").groupBy("id").agg(F.min("made").alias("made"))


def removed(w: World, chosen: DataFrame, with_contents: bool = False, made: DataFrame | None = None) -> DataFrame:
    """``id``: the chosen objects with all descendants and, ``with_contents``, what was made for them.

    Contents go with an object if they are no players and were made no earlier than the chosen object they are
    inside; ``made(id, made)`` tells when, by default the creation time.  Where several chosen objects lead to an
    object, the earliest counts.
    """
    from worldloom.functions import moo

    ids = w.objects.select("id")
    when = materialize((made if made is not None else created(w)).select("id", "made"), "made")
    child = w.objects.select(F.col("id").alias("src"), F.explode("children").alias("dst"))
    content = w.objects.select(F.col("id").alias("src"), F.explode("contents").alias("dst"))
    free = w.objects.filter(~moo.has_flag("flags", "player")).select("id").join(when, "id").withColumnsRenamed({"id": "dst", "made": "dst_made"})
    links = child.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", F.lit(None).cast("bigint").alias("dst_made"))
    if with_contents:
        links = links.unionByName(content.join(free, "dst").select("src", "dst", "dst_made"))
    links = materialize(links.distinct(), "removal-links")
    best = materialize(chosen.select("id").distinct().join(ids, "id", "left_semi").join(when, "id", "left").withColumnRenamed("made", "since"), "removed-0")
    front, d = best, 0
    while True:
        d += 1
        step = front.join(links, front.id == links.src).filter("dst_made IS NULL OR dst_made >= since").select(F.col("dst").alias("id"), "since")
        step = step.groupBy("id").agg(F.min("since").alias("since"))
        # An object is followed again only where an earlier time lets more of its contents go.
        known = best.select("id", F.col("since").alias("had"), F.lit(True).alias("seen"))
        front = materialize(step.join(known, "id", "left").filter("seen IS NULL OR (since IS NOT NULL AND (had IS NULL OR since < had))").select("id", "since"), f"removed-front-{d}")
        if front.isEmpty():
            return best.select("id")
        best = materialize(best.join(front.select("id"), "id", "left_anti").unionByName(front), f"removed-{d}")


def removal(w: World, chosen: DataFrame, with_contents: bool = False, made: DataFrame | None = None) -> DataFrame:
    """What removing ``chosen(id)`` does to what stays: ``effect, dst, kind, n``.

    ``inbound``: references from objects that stay to objects that go; ``dropped``: those of them the rewrite takes
    out by itself (children, contents and bookkeeping lists); ``stranded``: objects that stay, by the removed object
    they are in.  See ``removed`` for what goes.
    """
    e = materialize(edges(w), "edges")
    gone = materialize(removed(w, chosen, with_contents, made), "gone")
    inward = e.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    kept = F.col("kind").isin("child", "content") | ((F.col("kind") == "property") & F.lower(F.substring_index("evidence", ":", 1)).isin(*SET_LISTS))
    out = inward.groupBy(F.when(kept, "dropped").otherwise("inbound").alias("effect"), "dst", "kind").agg(F.count("*").alias("n"))
    stranded = inward.filter("kind = 'location'").groupBy("dst").agg(F.count("*").alias("n")).select(F.lit("stranded").alias("effect"), "dst", F.lit("location").alias("kind"), "n")
    return out.unionByName(stranded)


def audit(e: DataFrame, expectations: DataFrame) -> DataFrame:
    """``expectations(source, target, kind)`` with whether a direct edge of that kind is present."""
    have = e.select(F.col("src").alias("source"), F.col("dst").alias("target"), "kind").distinct().withColumn("ok", F.lit(1))
    return expectations.join(have, ["source", "target", "kind"], "left").select("source", "target", "kind", F.when(F.col("ok") == 1, "present").otherwise("missing").alias("verdict"))


def audit_paths(e: DataFrame, expectations: DataFrame, max_depth: int) -> DataFrame:
    """``expectations(source, target)`` with whether a path of at most ``max_depth`` edges leads there.

    ``present``, ``missing`` when the search from the source ended without it, ``unknown`` when it was cut off.
    """
    reached = materialize(below(e, expectations.select(F.col("source").alias("root")).filter("root IS NOT NULL").distinct(), max_depth + 1), "audit-reach")
    there = reached.filter(F.col("depth") <= max_depth).select(F.col("root").alias("source"), F.col("id").alias("target"), F.lit(1).alias("ok"))
    cut = reached.filter(F.col("depth") == max_depth + 1).select(F.col("root").alias("source"), F.lit(1).alias("cut")).distinct()
    j = expectations.join(there, ["source", "target"], "left").join(cut, "source", "left")
    return j.select("source", "target", F.when(F.col("ok") == 1, "present").when(F.col("cut") == 1, "unknown").otherwise("missing").alias("verdict"))


def edge_labels(w: World, e: DataFrame) -> DataFrame:
    """Edges with the names of both ends; null where an end does not exist."""
    n = w.objects.select("id", "name")
    return e.join(n.withColumnsRenamed({"id": "src", "name": "src_name"}), "src", "left").join(n.withColumnsRenamed({"id": "dst", "name": "dst_name"}), "dst", "left")


def ranked_targets(e: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most referenced targets of each kind (a top-k report); ties by number."""
    c = e.groupBy("kind", "dst").agg(F.count("*").alias("n"))
    by = W.partitionBy("kind").orderBy(F.desc("n"), "dst")
    return c.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= n).drop("r")


def effective_edges(w: World) -> DataFrame:
    """Property edges objects inherit through cleared properties: ``src, dst, kind, evidence, value_from``."""
    from worldloom.operators.inherit import effective_values

    got = effective_values(w).filter("value_json IS NOT NULL").select("oid", "name", "value_from", "value_json")
    origin = got.select("oid", "name", "value_from")
    as_own = World(w.objects, got.select("oid", "name", F.lit(0).alias("slot"), F.lit(0).cast("bigint").alias("owner"), F.lit(0).alias("perms"), "value_json"), w.verbs, w.waifs)
    r = references(as_own).select(F.col("holder_id").alias("src"), F.col("target").alias("dst"), "member", "path")
    return r.join(origin, (F.col("src") == F.col("oid")) & (F.col("member") == F.col("name"))).select("src", "dst", F.lit("inherited").alias("kind"), F.concat_ws(":", "member", "path").alias("evidence"), "value_from")


def with_overlay(w: World, e: DataFrame, overlay: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Edges with external ones added: ``overlay(src, dst, kind, evidence)`` of known kinds between existing objects.

    Unknown kinds and ends outside the dump are errors of the overlay, not edges.
    """
    ids = w.objects.select("id")
    ok = overlay.filter(F.col("kind").isin(*known)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if ok.count() != overlay.count():
        raise ValueError("the overlay has unknown kinds or ends outside the dump")
    return e.unionByName(overlay.select(*e.columns))


def bounded(e: DataFrame, root: int, max_depth: int, max_nodes: int, target: int | None = None) -> tuple[DataFrame, str]:
    """``id, depth`` of at most ``max_nodes`` nodes around ``root``, and what that proves.

    Nodes are taken level by level in order of their number.  The verdict is ``complete`` when nothing was cut off;
    with a ``target``, ``present`` when it was reached, ``missing`` when the search was complete without it, else
    ``unknown``.
    """
    links = materialize(e.select("src", "dst").distinct(), "bounded-links")
    spark = e.sparkSession
    seen = spark.createDataFrame([(root, 0)], "id bigint, depth int")
    front, n, cut = seen, 1, False
    for d in range(1, max_depth + 2):
        step = front.join(links, front.id == links.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        if d > max_depth:
            cut = cut or not step.isEmpty()
            break
        fresh = materialize(step.orderBy("id").limit(max_nodes - n + 1).withColumn("depth", F.lit(d)), f"bounded-{d}")
        here = fresh.count()
        if here == 0:
            break
        if n + here > max_nodes:
            cut = True
            fresh = materialize(fresh.orderBy("id").limit(max_nodes - n), f"bounded-cut-{d}")
            here = max_nodes - n
        n += here
        seen, front = seen.unionByName(fresh), fresh
        if here == 0:
            break
    if target is None:
        return seen, "unknown" if cut else "complete"
    if not seen.filter(F.col("id") == target).isEmpty():
        return seen, "present"
    return seen, "unknown" if cut else "missing"
