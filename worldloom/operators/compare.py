"""Comparing two dumps record by record: typed events, verb pairing, added lines, continuity and matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions.values import code_hash, value_hash
from worldloom.operators.inspect import World
from worldloom.session import materialize


def object_events(old: World, new: World) -> DataFrame:
    """``oid, field, change``: objects added or removed, and each differing field of objects in both."""
    fields = ["name", "flags", "owner", "location", "parents", "children", "contents"]
    pack = lambda w: w.objects.select("id", F.struct(*fields).alias("r"))
    j = pack(old).withColumnRenamed("r", "a").join(pack(new).withColumnRenamed("r", "b"), "id", "full")

    def differs(f: str) -> Column:
        a, b = F.col("a")[f], F.col("b")[f]
        if f in ("parents", "children", "contents"):
            # A permutation is a change of order, not of content.
            return F.when(a.eqNullSafe(b), None).when(F.array_sort(a).eqNullSafe(F.array_sort(b)), "order_changed").otherwise("changed")
        return F.when(~a.eqNullSafe(b), "changed")

    each = F.array_compact(F.array(*[F.when(differs(f).isNotNull(), F.struct(F.lit(f).alias("field"), differs(f).alias("change"))) for f in fields]))
    whole = lambda c: F.array(F.struct(F.lit("").alias("field"), F.lit(c).alias("change")))
    events = F.when(F.col("a").isNull(), whole("added")).when(F.col("b").isNull(), whole("removed")).otherwise(each)
    return j.select(F.col("id").alias("oid"), F.explode(events).alias("e")).select("oid", "e.field", "e.change")


def verb_pairs(old: World, new: World) -> DataFrame:
    """Verbs paired by object, names, arguments and occurrence: ``oid, name, change`` with trailer changes apart."""

    def keyed(w: World) -> DataFrame:
        occ = F.row_number().over(W.partitionBy("oid", "name", "args").orderBy("verb_index"))
        v = w.verbs.select("oid", "name", "verb_index", F.struct(F.shiftright("perms", 4).bitwiseAND(15).alias("p"), "preps").alias("args"), F.struct("owner", F.col("perms").bitwiseAND(15).alias("bits")).alias("meta"), F.struct(code_hash("code").alias("h")).alias("code"))
        return v.withColumn("occ", occ).select("oid", "name", "args", "occ", F.struct("meta", "code").alias("r"))

    on = ["oid", "name", "args", "occ"]
    j = keyed(old).withColumnRenamed("r", "a").join(keyed(new).withColumnRenamed("r", "b"), on, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.code").eqNullSafe(F.col("b.code")), "code").when(~F.col("a.meta").eqNullSafe(F.col("b.meta")), "meta")
    return j.select("oid", "name", change.alias("change")).filter("change IS NOT NULL")


def added_properties(old: World, new: World) -> DataFrame:
    """Properties of the newer dump whose object existed before without one of that name, in any case."""
    key = lambda w: w.properties.select("oid", F.lower("name").alias("k"), "name")
    fresh = key(new).join(key(old).select("oid", "k"), ["oid", "k"], "left_anti")
    return fresh.join(old.objects.select(F.col("id").alias("oid")), "oid", "left_semi").select("oid", "name")


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Align two programs on stripped lines; inserted and replaced lines of the newer one."""
    from difflib import SequenceMatcher

    for b in batches:
        out = []
        for oid, name, before, after in zip(b["oid"], b["name"], b["before"], b["after"]):
            before, after = ([] if x is None else list(x) for x in (before, after))
            m = SequenceMatcher(None, [(x or "").strip() for x in before], [(x or "").strip() for x in after], autojunk=False)
            for op, _, _, lo, hi in m.get_opcodes():
                if op in ("insert", "replace"):
                    out += [(oid, name, i + 1, after[i]) for i in range(lo, hi)]
        yield pd.DataFrame(out, columns=["oid", "name", "line_no", "line"])


def added_lines(old: World, new: World) -> DataFrame:
    """``oid, name, line_no, line``: code lines of the newer dump that the older program did not have."""
    a = old.verbs.select("oid", "name", F.col("code").alias("before"))
    b = new.verbs.select("oid", "name", F.col("code").alias("after"))
    pairs = b.join(a, ["oid", "name"], "left").filter(~F.col("before").eqNullSafe(F.col("after")))
    return pairs.mapInPandas(_added, "oid bigint, name string, line_no int, line string")


def continuity(old: World, new: World, identity: str = "creation_time") -> DataFrame:
    """What each number of the newer dump means in the older one: ``id, verdict``.

    ``absent``: the older dump has no such object.  ``same`` and ``reused``: the shown values of the identity
    property are equal or differ.  ``unproven``: either side shows no value for it.
    """
    from dataclasses import replace

    from worldloom.operators.inherit import all_values

    def shown(w: World) -> DataFrame:
        only = replace(w, properties=w.properties.filter(F.lower("name") == identity.lower()))
        v = all_values(only).filter(F.col("value_from").isNotNull() & F.col("value_json").isNotNull())
        return v.groupBy("oid").agg(F.min_by(F.struct(value_hash("value_json").alias("h")), "name").alias("v")).select(F.col("oid").alias("id"), "v")

    was, now = (shown(w).withColumnRenamed("v", n) for w, n in ((old, "was"), (new, "now")))
    before = old.objects.select("id", F.lit(True).alias("there"))
    j = new.objects.select("id").join(before, "id", "left").join(was, "id", "left").join(now, "id", "left")
    verdict = F.when(F.col("there").isNull(), "absent").when(F.col("was").isNull() | F.col("now").isNull(), "unproven").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("reused")
    return j.select("id", verdict.alias("verdict"))


#: Bits of the numbers in one array where a span of numbers is spelled out, and of those in a row such arrays are cut from.
_RUN, _SPAN = 13, 26


def _free(bounds: DataFrame, taken: DataFrame) -> DataFrame:
    """``id``: the numbers from ``lo`` to ``hi`` of the one row of ``bounds`` that ``taken`` does not have.

    No array is longer than a run, however far apart the bounds, and the numbers spelled out are not shuffled.
    """

    def cut(df: DataFrame, lo: str, hi: str, bits: int, name: str) -> DataFrame:
        step = F.lit(1 << bits).cast("bigint")
        # The end is not name + step - 1, which could pass the greatest number there is.
        return df.withColumn(name, F.explode(F.sequence(lo, hi, step))).withColumn(f"{name}_end", F.col(name) + F.least(step - 1, F.col(hi) - F.col(name)))

    n = lambda c: F.shiftright(F.col(c) - F.col("lo"), _RUN).alias("n")
    runs = cut(cut(bounds, "lo", "hi", _SPAN, "span"), "span", "span_end", _RUN, "run").select("run", "run_end", n("run"))
    held = taken.crossJoin(F.broadcast(bounds)).filter("id BETWEEN lo AND hi").groupBy(n("id")).agg(F.collect_set("id").alias("held"))
    # A run is a few bytes until it is spelled out: with a number given, and another key than the join's, Spark keeps the partitions apart.
    parts = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.join(held, "n", "left").repartition(parts, "run").select(F.explode(F.array_except(F.sequence("run", "run_end"), F.coalesce("held", F.array().cast("array<bigint>")))).alias("id"))


def lifecycle(old: World, new: World) -> DataFrame:
    """Numbers whose state differs: ``oid, old_state, new_state, change``; states are present, recycled or absent.

    Recycled are the numbers from 0 to the greatest in use that are no object.  ``changed`` where a recycled number
    is involved, else ``added`` or ``removed``.  Anonymous objects are left out.

    Gaps that both dumps have are never spelled out: only numbers of objects, and those between the greatest
    numbers of the two dumps, can differ.
    """
    real = lambda w, n: w.objects.filter("id >= 0").select("id", (~F.coalesce("anon", F.lit(False))).alias(n))
    known = materialize(real(old, "a").join(real(new, "b"), "id", "full"), "numbers")
    tops = known.agg(*[F.coalesce(F.max(F.when(F.col(n), F.col("id"))), F.lit(-1)).alias(f"top_{n}") for n in ("a", "b")])
    bounds = tops.select((F.least("top_a", "top_b") + 1).alias("lo"), F.greatest("top_a", "top_b").alias("hi")).filter("lo <= hi")
    numbers = known.unionByName(_free(bounds, known.select("id")), allowMissingColumns=True).crossJoin(F.broadcast(tops))

    def state(n: str) -> Column:
        return F.when(F.col(n), "present").when(F.col(n).isNull() & (F.col("id") <= F.col(f"top_{n}")), "recycled").otherwise("absent")

    a, b = state("a"), state("b")
    change = F.when((a == "recycled") | (b == "recycled"), "changed").when(a == "absent", "added").otherwise("removed")
    return numbers.filter(a != b).select(F.col("id").alias("oid"), a.alias("old_state"), b.alias("new_state"), change.alias("change"))


def affected(old: World, new: World) -> DataFrame:
    """``oid, name, change, n_affected``: properties added to or removed from objects in both dumps, and how many descendants inherit the change.

    Descendants are counted in the dump that has the property.
    """
    from worldloom.operators.graph import below

    both = old.objects.select("id").join(new.objects.select("id"), "id").withColumnRenamed("id", "oid")

    def one(a: World, b: World, change: str) -> DataFrame:
        key = lambda w: w.properties.select("oid", F.lower("name").alias("k"), "name")
        fresh = materialize(key(b).join(key(a).select("oid", "k"), ["oid", "k"], "left_anti").join(both, "oid", "left_semi").select("oid", "name"), f"{change}-properties")
        down = b.objects.select(F.explode("parents").alias("src"), F.col("id").alias("dst")).filter("src IS NOT NULL")
        n = below(down, fresh.select(F.col("oid").alias("root")).distinct()).filter("depth > 0").groupBy(F.col("root").alias("oid")).agg(F.count("*").alias("n_affected"))
        return fresh.join(n, "oid", "left").select("oid", "name", F.lit(change).alias("change"), F.coalesce("n_affected", F.lit(0)).alias("n_affected"))

    return one(old, new, "added").unionByName(one(new, old, "removed"))


def diff_footer(events: DataFrame) -> DataFrame:
    """Totals of object events by kind of change."""
    return events.groupBy("change").agg(F.count("*").alias("n_events"), F.count_distinct("oid").alias("n_objects"))


def survivor_order(old: World, new: World, of: str = "contents") -> DataFrame:
    """Objects whose surviving members of a list stand in another order: ``id``."""
    pick = lambda w, c: w.objects.select("id", F.col(of).alias(c))
    j = pick(old, "a").join(pick(new, "b"), "id")
    keep = lambda x, y: F.filter(F.array_distinct(x), lambda v: F.array_contains(y, v))
    return j.filter(~keep(F.col("a"), F.col("b")).eqNullSafe(keep(F.col("b"), F.col("a")))).select("id")


#: Fixed value: how the editor's footer line begins.
_FOOTER = '"Last modified '


def normalized(code: Column | str = "code") -> Column:
    """A program's lines without outer blanks, empty lines and the editor's footers."""
    c = F.col(code) if isinstance(code, str) else code
    return F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit(_FOOTER)))


def _digest(lines: Column | str) -> Column:
    return F.sha2(F.array_join(lines, "\n"), 256)


def exact_matches(w: World) -> DataFrame:
    """Groups of verbs with the same normalised program: ``digest, n_verbs, n_objects``, groups of two or more."""
    v = w.verbs.select("oid", normalized().alias("n")).filter(F.size("n") > 0)
    return v.select("oid", _digest("n").alias("digest")).groupBy("digest").agg(F.count("*").alias("n_verbs"), F.count_distinct("oid").alias("n_objects")).filter("n_verbs > 1")


def _programs(w: World) -> DataFrame:
    return w.verbs.select("oid", "name", normalized().alias("n")).filter("n IS NOT NULL").select("oid", "name", "n", _digest("n").alias("d"))


def program_matches(old: World, new: World, least: float = 0.5) -> DataFrame:
    """Where the older dump's programs are found anywhere in the newer one: ``oid, name, match, n_found, similarity``.

    ``exact``: a verb of the newer dump has the same normalised program.  ``similar``: else, one that shares an alias
    (in any case) has a multiset Jaccard of lines of at least ``least``.  ``new``: neither.  Verbs without lines are
    left out; ``n_found`` counts distinct programs found, ``similarity`` is the greatest.

    Equal programs are compared once.  Similar pairs meet by prefix filtering: of two programs that are alike enough,
    one of the rarest lines must be shared, so a common alias or a common line alone joins nothing.
    """
    a, b = _programs(old).filter(F.size("n") > 0), _programs(new)
    known = b.select("d").distinct()
    kinds = a.join(known.withColumn("exact", F.lit(True)), "d", "left").select("oid", "name", "n", "d", F.coalesce("exact", F.lit(False)).alias("exact"))
    kinds = materialize(kinds, "programs")
    open_ = kinds.filter("NOT exact")

    def alias_lines(p: DataFrame) -> tuple[DataFrame, DataFrame]:
        alias = p.select("d", F.explode(F.array_distinct(F.filter(F.split(F.lower("name"), r"\s+"), lambda x: x != ""))).alias("alias")).distinct()
        lines = p.groupBy("d").agg(F.any_value("n").alias("n")).select("d", F.size("n").alias("size"), F.explode("n").alias("line"))
        return alias, lines.groupBy("d", "size", "line").agg(F.count("*").alias("c"))

    (alias_a, lines_a), (alias_b, lines_b) = alias_lines(open_), alias_lines(b.filter(F.size("n") > 0))
    lines_a, lines_b = materialize(lines_a, "lines-old"), materialize(lines_b, "lines-new")
    rare = lines_a.select("line").unionByName(lines_b.select("line")).groupBy("line").agg(F.count("*").alias("f"))

    def prefix(lines: DataFrame) -> DataFrame:
        # Rarest lines first; a line standing c times counts c times.  More than size - least * size of them cannot all be unshared.
        before = F.coalesce(F.sum("c").over(W.partitionBy("d").orderBy("f", "line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return lines.join(rare, "line").withColumn("before", before).filter(F.col("before") <= F.col("size") - F.ceil(F.col("size") * F.lit(least))).select("d", "line")

    tokens = lambda alias, lines: alias.join(prefix(lines), "d")
    cand = tokens(alias_a, lines_a).withColumnRenamed("d", "da").join(tokens(alias_b, lines_b).withColumnRenamed("d", "db"), ["alias", "line"]).select("da", "db").distinct()
    both = cand.join(lines_a.withColumnsRenamed({"d": "da", "size": "size_a", "c": "ca"}), "da").join(lines_b.withColumnsRenamed({"d": "db", "size": "size_b", "c": "cb"}), ["db", "line"])
    same = both.groupBy("da", "db", "size_a", "size_b").agg(F.sum(F.least("ca", "cb")).alias("same"))
    close = same.select("da", (F.col("same") / (F.col("size_a") + F.col("size_b") - F.col("same"))).alias("s")).filter(F.col("s") >= least).groupBy(F.col("da").alias("d")).agg(F.count("*").alias("n"), F.max("s").alias("s"))
    return kinds.select("oid", "name", "d", "exact").join(close.withColumnRenamed("n", "n_close"), "d", "left").select(
        "oid", "name", F.when(F.col("exact"), "exact").when(F.col("n_close").isNotNull(), "similar").otherwise("new").alias("match"), F.when(F.col("exact"), 1).otherwise(F.coalesce("n_close", F.lit(0))).cast("bigint").alias("n_found"), F.when(F.col("exact"), 1.0).otherwise(F.col("s")).alias("similarity")
    )


def value_events(old: World, new: World) -> DataFrame:
    """``oid, name, change, tag_before, tag_after`` of properties whose typed value differs."""
    from worldloom.operators.inspect import tag

    p = lambda w: w.properties.select("oid", "name", F.struct(F.struct(value_hash("value_json").alias("h")).alias("v"), tag().alias("t")).alias("r"))
    j = p(old).withColumnRenamed("r", "a").join(p(new).withColumnRenamed("r", "b"), ["oid", "name"])
    d = j.filter(~F.col("a.v").eqNullSafe(F.col("b.v")))
    return d.select("oid", "name", F.when(F.col("a.t").eqNullSafe(F.col("b.t")), "changed").otherwise("type_mismatch").alias("change"), F.col("a.t").alias("tag_before"), F.col("b.t").alias("tag_after"))


def verdicts(old: World, new: World, least: float = 0.5) -> DataFrame:
    """Whether the newer dump has the older one's objects, by their programs: ``oid, n_verbs, n_exact, n_similar, verdict``.

    Verbs without lines are left out.  ``have it`` from 80 % exact matches, ``have a different version`` from 50 %
    exact or similar ones, else ``new``; objects without programs have ``no code``.
    """
    m = program_matches(old, new, least).groupBy("oid").agg(F.count("*").alias("n_verbs"), F.count_if(F.col("match") == "exact").alias("n_exact"), F.count_if(F.col("match") == "similar").alias("n_similar"))
    s = old.objects.select(F.col("id").alias("oid")).join(m, "oid", "left").fillna(0, ["n_verbs", "n_exact", "n_similar"])
    share = lambda n: F.col("n_verbs") * F.lit(n)
    verdict = F.when(F.col("n_verbs") == 0, "no code").when(F.col("n_exact") >= share(0.8), "have it").when(F.col("n_exact") + F.col("n_similar") >= share(0.5), "have a different version").otherwise("new")
    return s.withColumn("verdict", verdict)
