"""Queries over mail, waifs, timelines, rewriting, and the generic tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators import compare as C
from worldloom.operators import history, joins, mail, mailtree, rewrite, waifs
from worldloom.operators import inspect as I
from worldloom.plans.problems import _CANON, _LIVE, _LIVE_ONLY, _latest_sql
from worldloom.plans.relations import _EVENTS, O1
from worldloom.plans.rewrites import _nodes
from worldloom.plans.world import NODES, O, P, V
from worldloom.sources.tables import live_dumps, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

M = "m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id) AS rn FROM mail_messages) WHERE rn = 1)"
WAIFS = "w AS (SELECT DISTINCT * FROM moo_waifs)"


def query(name: str, sql: str | None = None):
    """Register a query over the session and the folder of tables."""

    def register(f):
        f.__name__ = name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("mail_headers", f"WITH {M} SELECT message_id, mailbox_oid, msg_number, CASE WHEN date_unix > 0 THEN strftime(to_timestamp(date_unix) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS sent, sender, subject, len(body)::INT AS n_lines FROM m")
def _(spark, sf):
    return mail.headers(table(spark, sf, "mail_messages"))


@query("mail_search", f"WITH {M} SELECT message_id, msg_number FROM m WHERE contains(lower(concat_ws(chr(10), sender, recipients, subject, array_to_string(headers, chr(10)), array_to_string(body, chr(10)))), 'velvet orchard') AND (msg_number BETWEEN 4 AND 60 OR msg_number BETWEEN 100 AND 120)")
def _(spark, sf):
    return mail.select(table(spark, sf, "mail_messages"), [(4, 60), (100, 120)], "Velvet Orchard").select("message_id", "msg_number")


@query("mail_tail", f"WITH {M} SELECT mailbox_oid, message_id FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_oid ORDER BY msg_number DESC, message_id DESC) AS r FROM m) WHERE r <= 2")
def _(spark, sf):
    return mail.select(table(spark, sf, "mail_messages"), last=2).select("mailbox_oid", "message_id")


@query("mail_lists", f"WITH {M} SELECT list_name, count(DISTINCT message_id) AS n_messages FROM (SELECT message_id, unnest(regexp_extract_all(recipients, '\\*([A-Za-z0-9_]+) \\(#[0-9]+\\)', 1)) AS list_name FROM m) GROUP BY list_name")
def _(spark, sf):
    return mail.lists(table(spark, sf, "mail_messages"))


@query("mailbox_summary", f"WITH {M} SELECT mailbox_oid, count(*) AS n, min(msg_number) AS first, max(msg_number) AS last, count(*) FILTER (NOT coalesce(date_unix > 0, false)) AS n_undated, max(msg_number) - min(msg_number) + 1 - count(*) AS n_gaps FROM m GROUP BY mailbox_oid")
def _(spark, sf):
    return mail.mailbox_summary(table(spark, sf, "mail_messages"))


_SLOTS = "s AS (SELECT DISTINCT waif_index, waif_class, json_extract_string(x, '$[0]')::INT AS slot, json_extract(x, '$[1]') AS v FROM (SELECT waif_index, waif_class, unnest(json_extract(props, '$[*]')) AS x FROM w WHERE json_valid(props)))"


@query("waif_slot_kinds", f"WITH {WAIFS}, {_SLOTS} SELECT waif_class, slot, json_extract_string(v, '$.type') AS tag, count(*) AS n FROM s GROUP BY 1, 2, 3")
def _(spark, sf):
    return waifs.slot_kinds(I.open_world(spark, sf))


@query("waif_sparse_share", f"WITH {WAIFS}, {_SLOTS}, n AS (SELECT waif_index, count(*) AS n_set FROM s GROUP BY waif_index) SELECT waif_class, count(*) AS n_waifs, sum(coalesce(n_set, 0))::BIGINT AS n_set, sum(propdefs_length)::BIGINT AS n_slots FROM w LEFT JOIN n USING (waif_index) GROUP BY waif_class")
def _(spark, sf):
    return waifs.sparse_share(I.open_world(spark, sf))


_IN_WAIFS = "sw AS (SELECT waif_index AS oid, slot::VARCHAR AS name, v::VARCHAR AS value_json FROM s)"


@query(
    "waif_holders",
    f"""WITH RECURSIVE {P}, {NODES}, {WAIFS}, {_SLOTS}, {_IN_WAIFS}, {_nodes("sw", "nw", "tw")}, inside AS (SELECT DISTINCT holder_id AS src, scalar::BIGINT AS dst FROM tw WHERE tag = 'waif'),
  c AS (SELECT DISTINCT holder_id, scalar::BIGINT AS waif_index FROM t WHERE tag = 'waif' UNION SELECT c.holder_id, i.dst FROM c JOIN inside i ON i.src = c.waif_index) SELECT holder_id, waif_index FROM c""",
)
def _(spark, sf):
    return waifs.holders(I.open_world(spark, sf))


_VALUE_TRUE = "CASE json_extract_string({0}, '$.type') WHEN 'int' THEN NOT regexp_matches(json_extract_string({0}, '$.value'), '^[-+]?0+$') WHEN 'float' THEN NOT regexp_matches(json_extract_string({0}, '$.bits'), '^[08]0{{15}}$') WHEN 'string' THEN length(json_extract_string({0}, '$.value')) > 0 WHEN 'bool' THEN json_extract_string({0}, '$.value') = 'true' WHEN 'list' THEN json_array_length({0}, '$.items') > 0 WHEN 'map' THEN json_array_length({0}, '$.entries') > 0 ELSE false END"


@query(
    "waif_groups",
    f"""WITH {WAIFS}, {_SLOTS}, every AS (SELECT DISTINCT waif_index, waif_class FROM w),
  zero AS (SELECT waif_index, waif_class, min(v::VARCHAR)::JSON AS v FROM s WHERE slot = 0 GROUP BY 1, 2), four AS (SELECT waif_index, waif_class, min(v::VARCHAR)::JSON AS v FROM s WHERE slot = 25 GROUP BY 1, 2),
  hit AS (SELECT waif_index, waif_class FROM four WHERE CASE WHEN json_extract_string(v, '$.type') = 'string' THEN regexp_matches(json_extract_string(v, '$.value'), 'e') ELSE len(list_filter(json_extract(v, '$.items[*]'), lambda x: json_extract_string(x, '$.type') = 'string' AND regexp_matches(json_extract_string(x, '$.value'), 'e'))) > 0 END)
SELECT waif_class, CASE WHEN z.v IS NULL THEN 'none' WHEN {_VALUE_TRUE.format("z.v")} THEN 'true' ELSE 'false' END AS by_0, count(*) AS n_waifs FROM every LEFT JOIN zero z USING (waif_index, waif_class)
WHERE (waif_index, waif_class) NOT IN (SELECT (waif_index, waif_class) FROM hit) GROUP BY 1, 2""",
)
def _(spark, sf):
    """Waifs of all classes without an ``e`` in slot 25, by class and truth of slot 0."""
    return waifs.grouped(I.open_world(spark, sf), None, [(0, True)], [(25, "e", True)])


@query("chain_pairs", "SELECT old_id, new_id, hours FROM (SELECT lag(snapshot_id) OVER w AS old_id, snapshot_id AS new_id, (epoch(taken_at - lag(taken_at) OVER w) / 3600)::BIGINT AS hours FROM moo_dumps WHERE world = 'live' WINDOW w AS (ORDER BY taken_at, snapshot_id)) WHERE old_id IS NOT NULL")
def _(spark, sf):
    return history.chain_pairs(table(spark, sf, "moo_dumps"))


@query("mail_as_of_dump", f"WITH {M} SELECT message_id, (SELECT max_by(snapshot_id, taken_at) FROM moo_dumps d WHERE world = 'live' AND d.taken_at <= make_timestamp(m.date_unix * 1000000)) AS snapshot_id FROM m")
def _(spark, sf):
    m = mail.messages(table(spark, sf, "mail_messages")).select("message_id", F.timestamp_seconds("date_unix").alias("at"))
    return history.dump_at(m, "at", table(spark, sf, "moo_dumps")).select("message_id", "snapshot_id")


@query(
    "presence_transitions",
    f"""WITH live AS ({_LIVE}), h AS (SELECT p.oid, p.name, live.i FROM {_latest_sql("moo_properties", "snapshot_id, oid, name")} p JOIN live USING (snapshot_id) WHERE regexp_matches(regexp_replace(value_json, '\\s+', '', 'g'), '\\{{("type":"obj","value":"-1"|"value":"-1","type":"obj")\\}}'))
SELECT h.oid, h.name, live.snapshot_id, 'appeared' AS transition FROM h JOIN live USING (i) WHERE h.i > 1 AND NOT EXISTS (SELECT 1 FROM h g WHERE g.oid = h.oid AND g.name = h.name AND g.i = h.i - 1)
UNION ALL SELECT h.oid, h.name, live.snapshot_id, 'disappeared' FROM h JOIN live ON live.i = h.i + 1 WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.oid = h.oid AND g.name = h.name AND g.i = h.i + 1)""",
)
def _(spark, sf):
    return history.presence(table(spark, sf, "moo_properties"), live_dumps(table(spark, sf, "moo_dumps")), -1)


_GONE = "g AS (SELECT id FROM o WHERE contains(lower(name), 'velvet')), nn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM o WHERE id >= 0 AND id NOT IN (SELECT id FROM g)), b AS (SELECT least(-1000000, min(least(id, owner, location)) - 1) AS base FROM o)"


def _velvet(w):
    return w.objects.filter(F.contains(F.lower("name"), F.lit("velvet"))).select("id")


@query("renumber_dense", f"WITH {O}, {_GONE} SELECT id, new_id FROM nn")
def _(spark, sf):
    w = I.open_world(spark, sf)
    return rewrite.renumbering(w, _velvet(w))


def _map_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} < 0 THEN {x} ELSE coalesce((SELECT new_id FROM nn WHERE nn.id = {x}), (SELECT base FROM b) - {x}) END"


def _list_sql(field: str) -> str:
    keep = "" if field == "parents" else "WHERE p IS NULL OR p NOT IN (SELECT id FROM g)"
    return f"""{field}_l AS (SELECT oid, list(CASE WHEN p IS NULL OR p < 0 THEN p ELSE coalesce(nn.new_id, (SELECT base FROM b) - p) END ORDER BY i) AS l FROM (SELECT * FROM (SELECT oid, unnest({field}) AS p, unnest(range(1, len({field}) + 1)) AS i FROM r) {keep}) x LEFT JOIN nn ON nn.id = x.p GROUP BY oid)"""


_LISTS = ("parents", "children", "contents")


@query(
    "renumbered_objects",
    f"""WITH {O}, {_GONE}, r AS (SELECT nn.new_id AS id, name, CASE WHEN owner IN (SELECT id FROM g) THEN 2 ELSE owner END AS ow, location AS lo, parents, children, contents, o.id AS oid FROM o JOIN nn ON nn.id = o.id), {", ".join(map(_list_sql, _LISTS))}
SELECT id, name, {_map_sql("ow")} AS owner, {_map_sql("lo")} AS location, {", ".join(f"array_to_string(coalesce({f}_l.l, CASE WHEN {f} IS NULL THEN NULL ELSE [] END), ',') AS {f}" for f in _LISTS)} FROM r {" ".join(f"LEFT JOIN {f}_l ON {f}_l.oid = r.oid" for f in _LISTS)}""",
)
def _(spark, sf):
    w = I.open_world(spark, sf)
    r = rewrite.renumbered(w, _velvet(w), owner_to=2)
    return r.withColumns({c: F.when(F.col(c).isNotNull(), F.concat_ws(",", F.col(c).cast("array<string>"))) for c in _LISTS})


@query("renumbered_owners", f"""WITH {O}, {V}, {P}, {_GONE} SELECT 'verb' AS kind, nn.new_id AS oid, name, {_map_sql("v.owner")} AS owner FROM v JOIN nn ON nn.id = v.oid UNION ALL SELECT 'property', nn.new_id, name, {_map_sql("p.owner")} FROM p JOIN nn ON nn.id = p.oid""")
def _(spark, sf):
    w = I.open_world(spark, sf)
    part = lambda kind, table_: rewrite.renumbered_members(w, _velvet(w), table_).select(F.lit(kind).alias("kind"), "oid", "name", "owner")
    return part("verb", "verbs").unionByName(part("property", "properties"))


@query("renumbered_values", f"""WITH RECURSIVE {O}, {P}, {_GONE}, {NODES} SELECT holder_id AS oid, member AS name, path, CASE WHEN x < 0 THEN x ELSE coalesce(nn.new_id, -1000000 - x) END AS number FROM (SELECT holder_id, member, path, scalar::BIGINT AS x FROM t WHERE tag = 'obj') LEFT JOIN nn ON nn.id = x""")
def _(spark, sf):
    """Object numbers in the rewritten values, read from the rewritten texts."""
    from dataclasses import replace

    w = I.open_world(spark, sf)
    new = rewrite.renumbered_values(w, rewrite.renumbering(w, _velvet(w)), -1_000_000)
    return I.references(replace(w, properties=new)).select(F.col("holder_id").alias("oid"), F.col("member").alias("name"), "path", F.col("target").alias("number"))


@query(
    "redacted_events",
    f"""WITH {O}, {O1}, {_EVENTS}, g AS (SELECT id FROM o WHERE flags & 1 <> 0) SELECT oid, field, change FROM ev WHERE oid NOT IN (SELECT id FROM g) UNION ALL SELECT DISTINCT oid, 'redacted', 'redacted' FROM ev WHERE oid IN (SELECT id FROM g)""",
)
def _(spark, sf):
    a, b = I.open_world(spark, sf, 1), I.open_world(spark, sf)
    return rewrite.redacted(C.object_events(a, b), b.objects.filter(moo.has_flag("flags", "player")).select(F.col("id").alias("oid")))


@query("reassigned", f"WITH {O}, {P}, {V} SELECT 'object' AS kind, count(*) AS n, 2::BIGINT AS new_owner FROM o WHERE owner = 10 UNION ALL SELECT 'property', count(*), 2 FROM p WHERE owner = 10 UNION ALL SELECT 'verb', count(*), 2 FROM v WHERE owner = 10")
def _(spark, sf):
    return rewrite.reassigned(I.open_world(spark, sf), 10, 2)


# Generic tables.


@query("asof_lookup", "SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return joins.as_of(e, o, ["user_id"], "ts", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("grep_page", f"""WITH {V}, h AS (SELECT oid, verb_index, name AS verb, len(list_filter(code, lambda x: regexp_matches(x, 'this'))) AS n_lines FROM v WHERE len(list_filter(code, lambda x: regexp_matches(x, 'this'))) > 0), t AS (SELECT sum(n_lines)::BIGINT AS total_lines, count(*) AS total FROM h)
SELECT oid, verb_index, verb, n_lines, total_lines, total, CASE WHEN total > 30 THEN 30 END AS next_offset FROM h, t ORDER BY oid, verb_index, verb LIMIT 20 OFFSET 10""")
def _(spark, sf):
    """The second page of the verbs that mention ``this`` (a page is the feature)."""
    return I.grep_page(I.grep(I.open_world(spark, sf), "this"), 10, 20)


@query("set_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def _(spark, sf):
    big = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").subtract(big)


@query("set_intersection", "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").intersect(o.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("multiset_difference", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 10 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter("l_quantity > 10").select("l_partkey", "l_suppkey").exceptAll(li.filter("l_quantity > 40").select("l_partkey", "l_suppkey"))


@query("occurrence_number", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem")
def _(spark, sf):
    by = W.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(by) - 1).alias("occurrence"))


@query(
    "float_close_diff",
    "SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN l_extendedprice * (1 + 1e-6) ELSE l_extendedprice * (1 + 1e-13) END AS x FROM lineitem) b USING (l_orderkey, l_linenumber) WHERE abs(a.l_extendedprice - b.x) > greatest(1e-9 * greatest(abs(a.l_extendedprice), abs(b.x)), 1e-12)",
)
def _(spark, sf):
    """Values of a mutated copy that are not close (relative 1e-9, absolute 1e-12)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    x = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_extendedprice") * (1 + 1e-6)).otherwise(F.col("l_extendedprice") * (1 + 1e-13))
    j = li.join(li.select("l_orderkey", "l_linenumber", x.alias("x")), ["l_orderkey", "l_linenumber"])
    far = F.abs(F.col("l_extendedprice") - F.col("x")) > F.greatest(1e-9 * F.greatest(F.abs("l_extendedprice"), F.abs("x")), F.lit(1e-12))
    return j.filter(far).select("l_orderkey", "l_linenumber")


@query("document_lines", "SELECT source, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^[+].*return') GROUP BY source")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("^[+].*return"))
    return d.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_distinct("doc_id").alias("n_docs"))


@query("document_fingerprints", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("duplicate_commits", "SELECT sha, count(*) AS n FROM documents WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1")
def _(spark, sf):
    return table(spark, sf, "documents").filter("sha IS NOT NULL").groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1")


@query("event_keys", "SELECT event_type, k, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props)) GROUP BY event_type, k")
def _(spark, sf):
    e = table(spark, sf, "events").filter(F.try_parse_json("props").isNotNull())
    return e.select("event_type", F.explode(F.json_object_keys("props")).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("region_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, sf):
    """Census of a containment tree at every level (region, nation, all)."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


_TREE = """n AS (SELECT oid, name AS member, json_extract_string(value_json, '$.items[0].value')::INT AS level, json_extract(value_json, '$.items[1].items[*]') AS es FROM p
    WHERE json_extract_string(value_json, '$.type') = 'list' AND json_extract_string(value_json, '$.items[0].type') = 'int' AND regexp_matches(json_extract_string(value_json, '$.items[0].value'), '^[0-9]{1,4}$') AND json_extract_string(value_json, '$.items[1].type') = 'list'),
  f AS (SELECT oid, member, level, unnest(range(1, len(es) + 1)) AS entry, unnest(es) AS e FROM n)"""


def _field(i: int, kind: str) -> str:
    return f"CASE WHEN json_extract_string(e, '$.items[{i - 1}].type') = '{kind}' THEN json_extract_string(e, '$.items[{i - 1}].value') END"


@query(
    "stored_mail",
    f"""WITH {P}, {_TREE} SELECT * FROM (SELECT oid, member, entry, {_field(2, "int")}::BIGINT AS number, {_field(3, "int")}::BIGINT AS date, {_field(4, "string")} AS sender, {_field(5, "string")} AS recipients, {_field(6, "string")} AS subject, {_field(1, "string")} AS body_property
FROM f WHERE level = 0 AND json_extract_string(e, '$.type') = 'list') WHERE number IS NOT NULL AND date IS NOT NULL AND sender IS NOT NULL AND recipients IS NOT NULL AND subject IS NOT NULL""",
)
def _(spark, sf):
    return mailtree.messages(I.open_world(spark, sf))


@query("stored_mail_faults")
def _(spark, sf):
    return mailtree.broken(I.open_world(spark, sf))
