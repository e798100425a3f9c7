"""Queries over inheritance, the relationship graph, and pairs of dumps, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators import compare as C
from worldloom.operators import graph as G
from worldloom.operators import inherit as H
from worldloom.operators import inspect as I
from worldloom.plans.problems import _CANON, _FIRST_PARENT, _latest_sql
from worldloom.plans.world import ALIASES, MASKED, NODES, O, P, V, _answers_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, pair: bool = False):
    """Register a query over the newest dump, or over the newest two (older first)."""

    def register(f):
        def run(spark, sf):
            return f(I.open_world(spark, sf, 1), I.open_world(spark, sf)) if pair else f(I.open_world(spark, sf))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


_BEFORE = "(SELECT snapshot_id FROM moo_dumps WHERE world = 'live' ORDER BY taken_at DESC LIMIT 1 OFFSET 1)"
O1 = f"o1 AS (SELECT * FROM {_latest_sql('moo_objects', 'snapshot_id, id')} WHERE snapshot_id = {_BEFORE})"
P1 = f"p1 AS (SELECT * FROM {_latest_sql('moo_properties', 'snapshot_id, oid, name')} WHERE snapshot_id = {_BEFORE})"
V1 = f"v1 AS (SELECT * FROM {_latest_sql('moo_verbs', 'snapshot_id, oid, name')} WHERE snapshot_id = {_BEFORE})"
EDGES = """e AS (SELECT id AS src, owner AS dst, 'owner' AS kind, '' AS evidence FROM o WHERE owner IS NOT NULL UNION ALL SELECT id, location, 'location', '' FROM o WHERE location IS NOT NULL
  UNION ALL SELECT * FROM (SELECT id, unnest(parents) AS d, 'parent', unnest(range(1, len(parents) + 1))::VARCHAR FROM o) WHERE d IS NOT NULL
  UNION ALL SELECT * FROM (SELECT id, unnest(children) AS d, 'child', unnest(range(1, len(children) + 1))::VARCHAR FROM o) WHERE d IS NOT NULL
  UNION ALL SELECT * FROM (SELECT id, unnest(contents) AS d, 'content', unnest(range(1, len(contents) + 1))::VARCHAR FROM o) WHERE d IS NOT NULL
  UNION ALL SELECT holder_id, scalar::BIGINT, 'property', member || ':' || path FROM t WHERE tag = 'obj')"""
WORLD = f"{O}, {P}, {NODES}, {EDGES}"
# Ancestors in depth-first order: the smallest path of parent positions to each ancestor.
ANCESTORS = """links2 AS (SELECT c, pos, p FROM (SELECT id AS c, unnest(parents) AS p, unnest(range(0, len(parents))) AS pos FROM o) WHERE p IN (SELECT id FROM o)),
  anc AS (SELECT id, id AS node, [0]::BIGINT[] AS path, [id] AS seen FROM o UNION ALL SELECT a.id, l.p, list_append(a.path, l.pos), list_append(a.seen, l.p) FROM anc a JOIN links2 l ON a.node = l.c WHERE NOT list_contains(a.seen, l.p)),
  ranked AS (SELECT id, node AS ancestor_id, row_number() OVER (PARTITION BY id ORDER BY path) - 1 AS rank FROM (SELECT id, node, min(path) AS path FROM anc GROUP BY id, node))"""


@query("ancestor_rank", f"WITH RECURSIVE {O}, {ANCESTORS} SELECT id, ancestor_id, rank FROM ranked")
def _(w):
    return H.ancestors(w)


def _first_answer(word: str) -> str:
    return f"""(SELECT id, min_by(oid, rank) AS oid, min_by(verb, rank) AS verb FROM ranked JOIN (SELECT oid, min_by(verb, (verb_index, verb)) AS verb FROM a WHERE {_answers_sql("alias", word)} GROUP BY oid) ON ancestor_id = oid GROUP BY id)"""


@query("verb_dispatch", f"""WITH RECURSIVE {O}, {V}, {ALIASES}, {ANCESTORS}, x AS {_first_answer("give")}, y AS {_first_answer(":give")}
SELECT * FROM x UNION ALL SELECT * FROM y WHERE id NOT IN (SELECT id FROM x)""")
def _(w):
    return H.dispatch(w, "give")


def shown_sql(n: str = "", o: str = "o", p: str = "p", only: str = "") -> str:
    """Cleared slots and the slot each takes its value from: the first parent's of that name, in any case."""
    return f"""s{n} AS (SELECT oid, name, lower(name) AS key, slot, coalesce(json_extract_string(value_json, '$.type') = 'clear', false) AS clear, value_json FROM {p} {only}),
  links{n} AS (SELECT c, pos, p FROM (SELECT id AS c, unnest(parents) AS p, unnest(range(0, len(parents))) AS pos FROM {o}) WHERE p IN (SELECT id FROM {o})),
  hold{n} AS (SELECT oid, key, min_by(name, (slot, name)) AS name FROM s{n} GROUP BY oid, key),
  next{n} AS (SELECT c.oid, c.name, min_by(h.oid, l.pos) AS to_oid, min_by(h.name, l.pos) AS to_name FROM s{n} c JOIN links{n} l ON l.c = c.oid JOIN hold{n} h ON h.oid = l.p AND h.key = c.key WHERE c.clear GROUP BY c.oid, c.name),
  look{n} AS (SELECT oid, name, to_oid, to_name, 1 AS steps FROM next{n} UNION ALL SELECT w.oid, w.name, x.to_oid, x.to_name, w.steps + 1 FROM look{n} w JOIN next{n} x ON x.oid = w.to_oid AND x.name = w.to_name WHERE w.steps < 500),
  shown{n} AS (SELECT c.oid, c.name, e.to_oid AS value_from, e.value_json, e.steps FROM s{n} c LEFT JOIN (SELECT k.oid, k.name, to_oid, steps, d.value_json FROM look{n} k JOIN s{n} d ON d.oid = to_oid AND d.name = to_name AND NOT d.clear) e ON e.oid = c.oid AND e.name = c.name WHERE c.clear)"""


SHOWN = shown_sql()


@query("effective_values", f"WITH RECURSIVE {O}, {P}, {SHOWN} SELECT oid, name, value_from, steps::INT AS steps FROM shown")
def _(w):
    return H.effective_values(w).drop("value_json")


@query("value_holders", f"WITH {P} SELECT count(*) AS n_objects, count(*) FILTER (coalesce(json_extract_string(value_json, '$.type') <> 'clear', true)) AS n_own FROM p WHERE lower(name) = 'description'")
def _(w):
    return H.holders(w, "description")


@query("graph_edges", f"WITH RECURSIVE {WORLD} SELECT src, dst, kind, evidence FROM e")
def _(w):
    return G.edges(w)


@query("incoming_edges", f"WITH RECURSIVE {WORLD} SELECT src, dst, kind, evidence FROM e WHERE dst IN (SELECT id FROM o WHERE flags & 4 <> 0)")
def _(w):
    return G.edges(w).join(w.objects.filter(moo.has_flag("flags", "wizard")).select(F.col("id").alias("dst")), "dst", "left_semi")


@query("edge_status", f"WITH RECURSIVE {WORLD} SELECT kind, CASE WHEN dst < 0 THEN 'special' WHEN dst IN (SELECT id FROM o) THEN 'object' ELSE 'dangling' END AS status, count(*) AS n FROM e GROUP BY 1, 2")
def _(w):
    return G.status(w, G.edges(w)).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("dangling_edges", f"WITH RECURSIVE {WORLD} SELECT src, dst, kind, evidence FROM e WHERE dst >= 0 AND dst NOT IN (SELECT id FROM o)")
def _(w):
    return G.status(w, G.edges(w)).filter("status = 'dangling'").drop("status")


@query("edge_labels", f"WITH RECURSIVE {WORLD} SELECT src, dst, kind, evidence, a.name AS src_name, b.name AS dst_name FROM e LEFT JOIN o a ON a.id = src LEFT JOIN o b ON b.id = dst WHERE kind = 'location'")
def _(w):
    return G.edge_labels(w, G.edges(w).filter("kind = 'location'"))


@query("top_targets", f"WITH RECURSIVE {WORLD} SELECT kind, dst, n FROM (SELECT kind, dst, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, dst) AS r FROM e GROUP BY kind, dst) WHERE r <= 3")
def _(w):
    return G.ranked_targets(G.edges(w))


@query(
    "neighbourhood",
    f"""WITH RECURSIVE {WORLD}, b AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 3) SELECT id, min(depth)::INT AS depth FROM b GROUP BY id""",
)
def _(w):
    e = G.edges(w)
    return G.neighbourhood(e, w.objects.filter("id = 0").select("id"), 3)


@query(
    "shortest_paths",
    f"""WITH RECURSIVE {WORLD}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('property', 'location')),
  b AS (SELECT id, 0 AS depth, [id] AS via FROM o WHERE flags & 4 <> 0 UNION ALL SELECT k.dst, b.depth + 1, list_append(b.via, k.dst) FROM b JOIN k ON k.src = b.id WHERE b.depth < 2 AND NOT list_contains(b.via, k.dst)),
  best AS (SELECT id, min(depth) AS depth FROM b GROUP BY id) SELECT id, best.depth::INT AS depth, array_to_string(min(via), '/') AS path FROM b JOIN best USING (id) WHERE b.depth = best.depth GROUP BY id, best.depth""",
)
def _(w):
    e = G.edges(w).filter(F.col("kind").isin("property", "location"))
    return G.shortest_paths(e, w.objects.filter(moo.has_flag("flags", "wizard")).select("id"), 2)


@query(
    "tree_summary",
    f"""WITH RECURSIVE {O}, k AS (SELECT src, dst, dst IN (SELECT id FROM o) AS there FROM (SELECT id AS src, unnest(children) AS dst FROM o) WHERE dst IS NOT NULL), kk AS (SELECT DISTINCT src, dst FROM k WHERE there),
  b AS (SELECT id AS root, id, 0 AS depth, [id] AS seen FROM o UNION ALL SELECT b.root, kk.dst, b.depth + 1, list_append(b.seen, kk.dst) FROM b JOIN kk ON kk.src = b.id WHERE NOT list_contains(b.seen, kk.dst)),
  m AS (SELECT root, id, min(depth) AS depth FROM b GROUP BY root, id), per AS (SELECT src, count(*) FILTER (there) AS r, count(*) FILTER (NOT there) AS x FROM k GROUP BY src)
SELECT root, count(*) FILTER (depth = 1) AS n_direct, count(*) FILTER (depth > 0) AS n_descendants, count(*) FILTER (depth > 0 AND r IS NULL) AS n_leaves, max(depth)::INT AS max_depth, coalesce(sum(x), 0)::BIGINT AS n_missing, (coalesce(sum(r), 0) - count(*) FILTER (depth > 0))::BIGINT AS n_repeated
FROM m LEFT JOIN per ON per.src = m.id GROUP BY root""",
)
def _(w):
    return G.tree_summary(w)


@query(
    "descendant_levels",
    f"""WITH RECURSIVE {O}, k AS (SELECT id AS src, unnest(children) AS dst FROM o), b AS (SELECT id, 0 AS depth FROM o WHERE id = 1 UNION SELECT k.dst, b.depth + 1 FROM b JOIN k ON k.src = b.id WHERE k.dst IS NOT NULL AND b.depth < 200)
SELECT depth::INT AS depth, count(*) AS n FROM (SELECT id, min(depth) AS depth FROM b GROUP BY id) GROUP BY depth""",
)
def _(w):
    """Objects below the root class by their least distance, along stored children."""
    e = w.objects.select(F.col("id").alias("src"), F.explode("children").alias("dst")).filter("dst IS NOT NULL")
    return G.neighbourhood(e, w.objects.filter("id = 1").select("id")).groupBy("depth").agg(F.count("*").alias("n"))


@query(
    "census_top",
    f"""WITH RECURSIVE {O}, b AS (SELECT id, id AS at, [id] AS seen FROM o UNION ALL SELECT b.id, n.id, list_append(b.seen, n.id) FROM b JOIN o c ON c.id = b.at JOIN o n ON n.id = c.location WHERE NOT list_contains(b.seen, n.id)),
  f AS (SELECT b.id, b.at FROM b JOIN o c ON c.id = b.at WHERE c.location IS NULL OR c.location NOT IN (SELECT id FROM o))
SELECT top, count(*) AS n FROM (SELECT o.id, f.at AS top FROM o LEFT JOIN f ON f.id = o.id) GROUP BY top""",
)
def _(w):
    return G.outermost(w).groupBy("top").agg(F.count("*").alias("n"))


@query(
    "unreachable_by_owner",
    f"""WITH RECURSIVE {WORLD}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('parent', 'location', 'content', 'property')), b AS (SELECT id FROM o WHERE id = 0 OR flags & 1 <> 0 UNION SELECT k.dst FROM b JOIN k ON k.src = b.id)
SELECT owner, count(*) AS n FROM o WHERE id NOT IN (SELECT id FROM b) GROUP BY owner""",
)
def _(w):
    return G.unreachable(w).groupBy("owner").agg(F.count("*").alias("n"))


@query(
    "removal_plan",
    f"""WITH RECURSIVE {WORLD}, made AS (SELECT id, last_move AS made FROM o WHERE last_move IS NOT NULL),
  k AS (SELECT src, dst, NULL::BIGINT AS dm FROM e WHERE kind = 'child' AND dst IN (SELECT id FROM o) UNION SELECT src, dst, made FROM e JOIN made ON made.id = dst JOIN o ON o.id = dst WHERE e.kind = 'content' AND coalesce(o.flags & 1, 0) = 0),
  b AS (SELECT o.id, made AS since FROM o LEFT JOIN made ON made.id = o.id WHERE contains(lower(name), 'velvet') UNION SELECT k.dst, b.since FROM b JOIN k ON k.src = b.id WHERE dm IS NULL OR dm >= b.since),
  i AS (SELECT * FROM e WHERE dst IN (SELECT id FROM b) AND src NOT IN (SELECT id FROM b))
SELECT CASE WHEN kind IN ('child', 'content') OR (kind = 'property' AND lower(split_part(evidence, ':', 1)) IN ('owned_objects', 'lost_souls')) THEN 'dropped' ELSE 'inbound' END AS effect, dst, kind, count(*) AS n FROM i GROUP BY 1, 2, 3
UNION ALL SELECT 'stranded', dst, 'location', count(*) FROM i WHERE kind = 'location' GROUP BY dst""",
)
def _(w):
    """The test world keeps no creation times; the last move stands for them."""
    made = w.objects.filter("last_move IS NOT NULL").select("id", F.col("last_move").alias("made"))
    return G.removal(w, w.objects.filter(F.contains(F.lower("name"), F.lit("velvet"))).select("id"), True, made)


@query("audit_expectations", f"WITH RECURSIVE {WORLD} SELECT id AS source, owner AS target, 'location' AS kind, CASE WHEN (id, owner) IN (SELECT (src, dst) FROM e WHERE kind = 'location') THEN 'present' ELSE 'missing' END AS verdict FROM o WHERE owner IS NOT NULL")
def _(w):
    want = w.objects.filter("owner IS NOT NULL").select(F.col("id").alias("source"), F.col("owner").alias("target"), F.lit("location").alias("kind"))
    return G.audit(G.edges(w), want)


@query(
    "audit_paths",
    f"""WITH RECURSIVE {O}, k AS (SELECT DISTINCT src, dst FROM (SELECT id AS src, unnest(parents) AS dst FROM o) WHERE dst IS NOT NULL), b AS (SELECT id AS root, id, 0 AS depth FROM o UNION SELECT b.root, k.dst, b.depth + 1 FROM b JOIN k ON k.src = b.id WHERE b.depth < 4), m AS (SELECT root, id, min(depth) AS depth FROM b GROUP BY root, id)
SELECT o.id AS source, 1::BIGINT AS target, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.root = o.id AND m.id = 1 AND depth <= 3) THEN 'present' WHEN EXISTS (SELECT 1 FROM m WHERE m.root = o.id AND depth = 4) THEN 'unknown' ELSE 'missing' END AS verdict FROM o""",
)
def _(w):
    """Whether each object inherits from #1 within three steps."""
    up = w.objects.select(F.col("id").alias("src"), F.explode("parents").alias("dst")).filter("dst IS NOT NULL")
    return G.audit_paths(up, w.objects.select(F.col("id").alias("source"), F.lit(1).cast("bigint").alias("target")), 3)


def _field_sql(f: str) -> str:
    lists = f in ("parents", "children", "contents")
    change = f"CASE WHEN list_sort(a.{f}) IS NOT DISTINCT FROM list_sort(b.{f}) THEN 'order_changed' ELSE 'changed' END" if lists else "'changed'"
    return f"SELECT a.id AS oid, '{f}' AS field, {change} AS change FROM o1 a JOIN o b ON a.id = b.id WHERE a.{f} IS DISTINCT FROM b.{f}"


_EVENTS = f"""ev AS ({" UNION ALL ".join(_field_sql(f) for f in ("name", "flags", "owner", "location", "parents", "children", "contents"))}
  UNION ALL SELECT id, '', 'added' FROM o WHERE id NOT IN (SELECT id FROM o1) UNION ALL SELECT id, '', 'removed' FROM o1 WHERE id NOT IN (SELECT id FROM o))"""


@query("object_events", f"WITH {O}, {O1}, {_EVENTS} SELECT oid, field, change FROM ev", pair=True)
def _(a, b):
    return C.object_events(a, b)


@query("diff_footer", f"WITH {O}, {O1}, {_EVENTS} SELECT change, count(*) AS n_events, count(DISTINCT oid) AS n_objects FROM ev GROUP BY change", pair=True)
def _(a, b):
    return C.diff_footer(C.object_events(a, b))


_STATE = "{0} AS (SELECT range AS id, CASE WHEN range IN (SELECT id FROM {1} WHERE NOT coalesce(anon, false)) THEN 'present' WHEN range NOT IN (SELECT id FROM {1}) THEN 'recycled' END AS state FROM range(0, (SELECT max(id) FILTER (NOT coalesce(anon, false)) FROM {1}) + 1))"


@query(
    "lifecycle",
    f"""WITH {O}, {O1}, {_STATE.format("sa", "o1")}, {_STATE.format("sb", "o")}, j AS (SELECT id AS oid, coalesce(a.state, 'absent') AS old_state, coalesce(b.state, 'absent') AS new_state FROM (SELECT * FROM sa WHERE state IS NOT NULL) a FULL JOIN (SELECT * FROM sb WHERE state IS NOT NULL) b USING (id))
SELECT *, CASE WHEN 'recycled' IN (old_state, new_state) THEN 'changed' WHEN old_state = 'absent' THEN 'added' ELSE 'removed' END AS change FROM j WHERE old_state <> new_state""",
    pair=True,
)
def _(a, b):
    return C.lifecycle(a, b)


def _affected_sql(p: str, q: str, o: str, other: str, change: str) -> str:
    return f"""SELECT oid, name, '{change}' AS change, (SELECT count(DISTINCT d) FROM down_{change} x WHERE x.id = f.oid AND d <> f.oid) AS n_affected FROM {p} f WHERE oid IN (SELECT id FROM {o}) AND oid IN (SELECT id FROM {other}) AND NOT EXISTS (SELECT 1 FROM {q} g WHERE g.oid = f.oid AND lower(g.name) = lower(f.name))"""


@query(
    "affected_descendants",
    f"""WITH RECURSIVE {O}, {O1}, {P}, {P1}, up AS (SELECT id, unnest(parents) AS p FROM o), up1 AS (SELECT id, unnest(parents) AS p FROM o1),
  down_added AS (SELECT p AS id, id AS d FROM up WHERE p IS NOT NULL UNION SELECT x.id, up.id FROM down_added x JOIN up ON up.p = x.d), down_removed AS (SELECT p AS id, id AS d FROM up1 WHERE p IS NOT NULL UNION SELECT x.id, up1.id FROM down_removed x JOIN up1 ON up1.p = x.d)
{_affected_sql("p", "p1", "o", "o1", "added")} UNION ALL {_affected_sql("p1", "p", "o1", "o", "removed")}""",
    pair=True,
)
def _(a, b):
    return C.affected(a, b)


@query(
    "verb_pairs",
    f"""WITH {V}, {V1}, k1 AS (SELECT *, row_number() OVER (PARTITION BY oid, name, (perms >> 4) & 15, preps ORDER BY verb_index) AS occ FROM v1), k2 AS (SELECT *, row_number() OVER (PARTITION BY oid, name, (perms >> 4) & 15, preps ORDER BY verb_index) AS occ FROM v)
SELECT coalesce(a.oid, b.oid) AS oid, coalesce(a.name, b.name) AS name, CASE WHEN a.oid IS NULL THEN 'added' WHEN b.oid IS NULL THEN 'removed' WHEN a.code IS DISTINCT FROM b.code THEN 'code' ELSE 'meta' END AS change
FROM k1 a FULL JOIN k2 b ON a.oid = b.oid AND a.name = b.name AND (a.perms >> 4) & 15 = (b.perms >> 4) & 15 AND a.preps = b.preps AND a.occ = b.occ
WHERE a.oid IS NULL OR b.oid IS NULL OR a.code IS DISTINCT FROM b.code OR a.owner IS DISTINCT FROM b.owner OR a.perms & 15 IS DISTINCT FROM b.perms & 15""",
    pair=True,
)
def _(a, b):
    return C.verb_pairs(a, b)


@query("added_properties", f"WITH {P}, {P1}, {O1} SELECT oid, name FROM p WHERE oid IN (SELECT id FROM o1) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.oid = p.oid AND lower(p1.name) = lower(p.name))", pair=True)
def _(a, b):
    return C.added_properties(a, b)


@query("added_lines", pair=True)
def _(a, b):
    return C.added_lines(a, b)


def _identity_sql(n: str, o: str, p: str, name: str) -> str:
    """Shown values of one property by object."""
    canon = _CANON.replace("value_json", "u.value_json")
    return f"""{shown_sql(n, o, p, f"WHERE lower(name) = '{name}'")}, id{n} AS (SELECT oid, min_by(c, name) AS c FROM (SELECT oid, name, {canon} AS c FROM (SELECT oid, name, value_json FROM s{n} WHERE NOT clear AND value_json IS NOT NULL UNION ALL SELECT oid, name, value_json FROM shown{n} WHERE value_from IS NOT NULL AND value_json IS NOT NULL) u) GROUP BY oid)"""


@query(
    "continuity",
    f"""WITH RECURSIVE {O}, {O1}, {P}, {P1}, {_identity_sql("x", "o1", "p1", "key")}, {_identity_sql("y", "o", "p", "key")}
SELECT o.id, CASE WHEN o.id NOT IN (SELECT id FROM o1) THEN 'absent' WHEN x.c IS NULL OR y.c IS NULL THEN 'unproven' WHEN x.c = y.c THEN 'same' ELSE 'reused' END AS verdict FROM o LEFT JOIN idx x ON x.oid = o.id LEFT JOIN idy y ON y.oid = o.id""",
    pair=True,
)
def _(a, b):
    """The test world has no creation times; another property that objects keep stands for them."""
    return C.continuity(a, b, "key")


_LINES = "list_filter(list_transform(code, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '\"Last modified '))"
_MATCHES = f"""a1 AS (SELECT DISTINCT oid, name, lower(alias) AS alias FROM (SELECT oid, name, unnest(string_split_regex(name, '\\s+')) AS alias FROM v1) WHERE alias <> ''), a2 AS (SELECT DISTINCT oid, name, lower(alias) AS alias FROM (SELECT oid, name, unnest(string_split_regex(name, '\\s+')) AS alias FROM v) WHERE alias <> ''),
  m1 AS (SELECT * FROM (SELECT oid, name, {_LINES} AS n FROM v1) WHERE len(n) > 0), m2 AS (SELECT oid, name, {_LINES} AS n FROM v WHERE code IS NOT NULL),
  q1 AS (SELECT *, EXISTS (SELECT 1 FROM m2 WHERE m2.n = m1.n) AS exact FROM m1),
  c1 AS (SELECT oid, name, z, line, count(*) AS c FROM (SELECT oid, name, len(n) AS z, unnest(n) AS line FROM q1 WHERE NOT exact) GROUP BY ALL), c2 AS (SELECT n, z, line, count(*) AS c FROM (SELECT n, len(n) AS z, unnest(n) AS line FROM (SELECT DISTINCT n FROM m2)) GROUP BY ALL),
  cand AS (SELECT DISTINCT a1.oid, a1.name, m2.n FROM a1 JOIN a2 USING (alias) JOIN m2 ON m2.oid = a2.oid AND m2.name = a2.name JOIN q1 ON q1.oid = a1.oid AND q1.name = a1.name AND NOT q1.exact),
  sim AS (SELECT oid, name, count(*) AS n, max(s) AS s FROM (SELECT cand.oid, cand.name, cand.n, sum(least(c1.c, c2.c))::DOUBLE / (c1.z + c2.z - sum(least(c1.c, c2.c))) AS s FROM cand JOIN c1 ON c1.oid = cand.oid AND c1.name = cand.name JOIN c2 ON c2.n = cand.n AND c2.line = c1.line GROUP BY cand.oid, cand.name, cand.n, c1.z, c2.z) WHERE s >= 0.5 GROUP BY oid, name),
  found AS (SELECT q1.oid, q1.name, CASE WHEN exact THEN 'exact' WHEN sim.n IS NOT NULL THEN 'similar' ELSE 'new' END AS match, CASE WHEN exact THEN 1 ELSE coalesce(sim.n, 0) END::BIGINT AS n_found, CASE WHEN exact THEN 1.0 ELSE sim.s END::DOUBLE AS similarity FROM q1 LEFT JOIN sim ON sim.oid = q1.oid AND sim.name = q1.name)"""


@query("exact_matches", f"""WITH {V}, m AS (SELECT oid, {_LINES} AS n FROM v)
SELECT sha256(array_to_string(n, chr(10))) AS digest, count(*) AS n_verbs, count(DISTINCT oid) AS n_objects FROM m WHERE len(n) > 0 GROUP BY 1 HAVING count(*) > 1""")
def _(w):
    return C.exact_matches(w)


@query("similar_programs", f"WITH {V}, {V1}, {_MATCHES} SELECT * FROM found", pair=True)
def _(a, b):
    return C.program_matches(a, b)


@query("value_events", f"""WITH {P}, {P1} SELECT oid, name, CASE WHEN ta = tb THEN 'changed' ELSE 'type_mismatch' END AS change, ta AS tag_before, tb AS tag_after FROM (SELECT a.oid, a.name, json_extract_string(a.value_json, '$.type') AS ta, json_extract_string(b.value_json, '$.type') AS tb,
  {_CANON.replace("value_json", "a.value_json")} AS ca, {_CANON.replace("value_json", "b.value_json")} AS cb FROM p1 a JOIN p b ON a.oid = b.oid AND a.name = b.name) WHERE ca IS DISTINCT FROM cb""", pair=True)
def _(a, b):
    return C.value_events(a, b)


@query(
    "survivor_order",
    f"""WITH {O}, {O1} SELECT a.id FROM o1 a JOIN o b ON a.id = b.id WHERE
  list_filter(list_transform(list_filter(list_zip(a.children, range(1, len(a.children) + 1)), lambda z: list_position(a.children, z[1]) = z[2]), lambda z: z[1]), lambda x: list_contains(b.children, x)) IS DISTINCT FROM
  list_filter(list_transform(list_filter(list_zip(b.children, range(1, len(b.children) + 1)), lambda z: list_position(b.children, z[1]) = z[2]), lambda z: z[1]), lambda x: list_contains(a.children, x))
  AND a.children IS NOT NULL AND b.children IS NOT NULL""",
    pair=True,
)
def _(a, b):
    return C.survivor_order(a, b, "children").join(a.objects.filter("children IS NOT NULL").select("id"), "id", "left_semi").join(b.objects.filter("children IS NOT NULL").select("id"), "id", "left_semi")


@query("holder_occurrence", f"WITH {P} SELECT oid, name, row_number() OVER (PARTITION BY oid, lower(name) ORDER BY slot, name) - 1 AS occurrence FROM p")
def _(w):
    from pyspark.sql import Window

    by = Window.partitionBy("oid", F.lower("name")).orderBy("slot", "name")
    return w.properties.select("oid", "name", (F.row_number().over(by) - 1).alias("occurrence"))


@query("inbound_outside", f"""WITH RECURSIVE {WORLD}, {V}, {MASKED}, m AS (SELECT id FROM o WHERE owner IN (SELECT id FROM o WHERE flags & 4 <> 0))
SELECT dst AS target, count(*) AS n FROM (SELECT src, dst FROM e WHERE kind = 'property' UNION ALL SELECT oid, n::BIGINT FROM (SELECT oid, unnest(regexp_extract_all(' ' || seen || ' ', '[^A-Za-z0-9_#$-]#([0-9]+)', 1)) AS n FROM (SELECT DISTINCT oid, verb, line_no, seen FROM l)))
WHERE dst IN (SELECT id FROM m) AND src NOT IN (SELECT id FROM m) GROUP BY dst""")
def _(w):
    """References from outside to the objects wizards own, in values and in code outside strings."""
    members = w.objects.join(w.objects.filter(moo.has_flag("flags", "wizard")).select(F.col("id").alias("owner")), "owner", "left_semi").select("id")
    text = I.code_lines(w, True).select(F.col("oid").alias("src"), F.explode(F.regexp_extract_all("seen", F.lit(r"(?<![\w#$-])#(\d+)(?!\d)"), F.lit(1))).alias("n"))
    both = I.references(w).select(F.col("holder_id").alias("src"), F.col("target").alias("dst")).unionByName(text.select("src", F.col("n").try_cast("bigint").alias("dst")))
    inward = both.join(members.withColumnRenamed("id", "dst"), "dst", "left_semi").join(members.withColumnRenamed("id", "src"), "src", "left_anti")
    return inward.groupBy(F.col("dst").alias("target")).agg(F.count("*").alias("n"))


@query(
    "match_verdicts",
    f"""WITH {V}, {V1}, {O1}, {_MATCHES}, g AS (SELECT oid, count(*) AS n_verbs, count(*) FILTER (match = 'exact') AS n_exact, count(*) FILTER (match = 'similar') AS n_similar FROM found GROUP BY oid)
SELECT id AS oid, coalesce(n_verbs, 0) AS n_verbs, coalesce(n_exact, 0) AS n_exact, coalesce(n_similar, 0) AS n_similar, CASE WHEN n_verbs IS NULL THEN 'no code' WHEN n_exact >= n_verbs * 0.8 THEN 'have it' WHEN n_exact + n_similar >= n_verbs * 0.5 THEN 'have a different version' ELSE 'new' END AS verdict FROM o1 LEFT JOIN g ON g.oid = id""",
    pair=True,
)
def _(a, b):
    return C.verdicts(a, b)


@query("bounded_neighbourhood")
def _(w):
    """Up to 200 nodes within four steps of the root class along all edges (bounds are the feature)."""
    return G.bounded(G.edges(w), 1, 4, 200)[0]
