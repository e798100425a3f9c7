"""Queries over value differences, exports, policies and rewriting, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldloom.functions.literals import literal_of
from worldloom.functions.values import double_of_bits
from worldloom.operators import compare as C
from worldloom.operators import export, policy, report, rewrite, valuediff
from worldloom.operators import graph as G
from worldloom.operators import inspect as I
from worldloom.plans.problems import _CANON
from worldloom.plans.relations import O1, P1, SHOWN, V1
from worldloom.plans.world import MASKED, NODES, O, P, V

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


def _nodes(src: str, n: str, t: str) -> str:
    text = NODES.replace("FROM p WHERE", f"FROM {src} WHERE").replace("n AS (SELECT", f"{n} AS (SELECT").replace("FROM n WHERE", f"FROM {n} WHERE").replace("t AS (SELECT", f"{t} AS (SELECT")
    return text.replace("AS scalar FROM n)", f"AS scalar FROM {n})")


_CHANGED = f"""k AS (SELECT oid, name FROM (SELECT a.oid, a.name, {_CANON.replace("value_json", "a.value_json")} AS ca, {_CANON.replace("value_json", "b.value_json")} AS cb FROM p1 a JOIN p b ON a.oid = b.oid AND a.name = b.name) WHERE ca IS DISTINCT FROM cb),
  pa AS (SELECT p1.* FROM p1 JOIN k USING (oid, name)), pb AS (SELECT p.* FROM p JOIN k USING (oid, name))"""


def _nodes_by_key(src: str, n: str, t: str) -> str:
    """Value nodes whose map steps are named by key; the keys themselves are left out."""
    spelled = "coalesce(json_extract_string(e, '$.key.type') || ':' || lower(coalesce(json_extract_string(e, '$.key.value'), json_extract_string(e, '$.key.bits'))), i::VARCHAR)"
    return f"""{n} AS (SELECT oid AS holder_id, name AS member, '' AS path, value_json::JSON AS v FROM {src} WHERE value_json IS NOT NULL
    UNION ALL SELECT holder_id, member, CASE WHEN above = '' THEN seg ELSE above || '/' || seg END, v FROM (
      SELECT holder_id, member, path AS above, 'list:' || unnest(range(1, json_array_length(v, '$.items')::BIGINT + 1)) AS seg, unnest(json_extract(v, '$.items[*]')) AS v FROM {n} WHERE json_extract_string(v, '$.type') = 'list'
      UNION ALL SELECT holder_id, member, above, 'map:' || {spelled} || ':value', json_extract(e, '$.value') FROM (SELECT holder_id, member, path AS above, unnest(range(1, json_array_length(v, '$.entries')::BIGINT + 1)) AS i, unnest(json_extract(v, '$.entries[*]')) AS e FROM {n} WHERE json_extract_string(v, '$.type') = 'map'))),
  {t} AS (SELECT holder_id, member, path, json_extract_string(v, '$.type') AS tag, coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.bits')) AS scalar FROM {n})"""


def _number_sql(c: str) -> str:
    hi, lo = f"('0x' || substr({c}, 1, 8))::BIGINT", f"('0x' || substr({c}, 9, 8))::BIGINT"
    part = f"((({hi}) & 1048575)::DOUBLE * 4294967296.0 + {lo}) / 4503599627370496.0"
    return f"(CASE WHEN ({hi} >> 31) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * CASE ({hi} >> 20) & 2047 WHEN 2047 THEN NULL WHEN 0 THEN {part} * pow(2.0::DOUBLE, -1022) ELSE (1 + {part}) * pow(2.0::DOUBLE, (({hi} >> 20) & 2047) - 1023) END)"


def _diffs_sql(same: str) -> str:
    return f"""WITH RECURSIVE {P}, {P1}, {_CHANGED}, {_nodes_by_key("pa", "na", "ta")}, {_nodes_by_key("pb", "nb", "tb")}
SELECT * FROM (SELECT coalesce(x.holder_id, y.holder_id) AS oid, coalesce(x.member, y.member) AS name, coalesce(x.path, y.path) AS path, CASE WHEN y.path IS NULL THEN 'missing' WHEN x.path IS NULL THEN 'extra' WHEN x.tag <> y.tag THEN 'type_mismatch' WHEN x.scalar IS DISTINCT FROM y.scalar AND NOT {same} THEN 'changed' END AS kind
FROM ta x FULL JOIN tb y ON x.holder_id = y.holder_id AND x.member = y.member AND x.path = y.path) WHERE kind IS NOT NULL"""


@query("value_node_diffs", _diffs_sql("false"), pair=True)
def _(a, b):
    return valuediff.node_diffs(a, b)


@query("value_diff_summary", f"WITH d AS ({_diffs_sql('false')}) SELECT kind, count(*) AS n_diffs, count(DISTINCT (oid, name)) AS n_properties FROM d WHERE starts_with(path, 'map:') AND kind <> 'extra' GROUP BY kind", pair=True)
def _(a, b):
    return valuediff.summary(valuediff.node_diffs(a, b), ["missing", "changed", "type_mismatch"], "map:")


_NEAR = f"coalesce(CASE WHEN x.tag = 'float' AND y.tag = 'float' THEN abs({_number_sql('x.scalar')} - {_number_sql('y.scalar')}) <= greatest(1e-9 * greatest(abs({_number_sql('x.scalar')}), abs({_number_sql('y.scalar')})), 1e-12) END, false)"


@query("value_node_diffs_tolerant", _diffs_sql(_NEAR), pair=True)
def _(a, b):
    return valuediff.node_diffs(a, b, tolerant=True)


@query(
    "float_values",
    f"""WITH RECURSIVE {P}, {NODES}, f AS (SELECT holder_id, member, path, ('0x' || substr(scalar, 1, 8))::BIGINT AS hi, ('0x' || substr(scalar, 9, 8))::BIGINT AS lo FROM t WHERE tag = 'float'),
  g AS (SELECT *, (hi >> 20) & 2047 AS e, ((hi & 1048575)::DOUBLE * 4294967296.0 + lo) / 4503599627370496.0 AS m, CASE WHEN (hi >> 31) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM f)
SELECT holder_id, member, path, CASE WHEN e = 2047 THEN NULL WHEN e = 0 THEN s * m * pow(2.0::DOUBLE, -1022) ELSE s * (1 + m) * pow(2.0::DOUBLE, e - 1023) END AS number FROM g""",
)
def _(w):
    """Floats in stored values as numbers; infinities and NaN as null."""
    n = I.value_nodes(w).filter("tag = 'float'")
    x = double_of_bits("scalar")
    return n.select("holder_id", "member", "path", F.when(F.conv(F.substring("scalar", 1, 3), 16, 10).cast("bigint").bitwiseAND(0x7FF) != 0x7FF, x).alias("number"))


@query("program_listings", f"WITH {V} SELECT oid, name, '@program #' || oid || ':' || string_split(name, ' ')[1] || chr(10) || CASE WHEN len(code) > 0 THEN array_to_string(code, chr(10)) || chr(10) ELSE '' END || '.' AS text FROM v WHERE code IS NOT NULL")
def _(w):
    return export.listings(w)


@query("object_json")
def _(w):
    return export.nested_json(w)


@query("value_literals")
def _(w):
    """Stored values as literals."""
    return I.stored(w).select("oid", "name", literal_of("value_json").alias("literal"))


@query("source_diffs", pair=True)
def _(a, b):
    return report.source_diffs(a, b)


@query(
    "identified_events",
    f"""WITH {O}, {O1} SELECT id AS oid, change, sha256('=' || id || ' | ' || '=' || change || ' | 0') AS event_id FROM (SELECT id, 'added' AS change FROM o WHERE id NOT IN (SELECT id FROM o1) UNION ALL SELECT id, 'removed' FROM o1 WHERE id NOT IN (SELECT id FROM o))""",
    pair=True,
)
def _(a, b):
    ev = C.object_events(a, b).filter("field = ''").select("oid", "change")
    return report.identified(ev, ["oid", "change"]).select("oid", "change", "event_id")


@query("event_spans", f"""WITH {O}, {O1}, l AS (SELECT id % 7 AS bin, id, '{{"bin":' || id % 7 || ',"id":' || id || '}}' AS line FROM o) SELECT bin, id, octet_length(line::BLOB) + 1 AS size, (sum(octet_length(line::BLOB) + 1) OVER (PARTITION BY bin ORDER BY id) - octet_length(line::BLOB) - 1)::BIGINT AS start FROM l""", pair=True)
def _(a, b):
    """Byte spans of rows written as JSON lines into seven files."""
    return report.spans(b.objects.select((F.col("id") % 7).alias("bin"), "id"), "bin", ["id"]).select("bin", "id", "size", "start")


@query(
    "policy_matches",
    f"""WITH RECURSIVE {O}, {O1}, {P}, {P1}, {V}, {V1}, up AS (SELECT id, unnest(parents) AS p FROM o), up1 AS (SELECT id, unnest(parents) AS p FROM o1), s AS (SELECT 2::BIGINT AS id UNION SELECT up.id FROM s JOIN up ON up.p = s.id), s1 AS (SELECT 2::BIGINT AS id UNION SELECT up1.id FROM s1 JOIN up1 ON up1.p = s1.id)
SELECT * FROM (SELECT 'notes' AS rule, 'old' AS side, count(*) AS n FROM p1 WHERE lower(name) GLOB '*note*' UNION ALL SELECT 'notes', 'new', count(*) FROM p WHERE lower(name) GLOB '*note*' UNION ALL SELECT 'subtree', 'old', count(*) FROM v1 WHERE oid IN (SELECT id FROM s1) UNION ALL SELECT 'subtree', 'new', count(*) FROM v WHERE oid IN (SELECT id FROM s)) WHERE n > 0""",
    pair=True,
)
def _(a, b):
    rules = policy.parse({"rules": [{"name": "notes", "kind": "property", "pattern": "*note*"}, {"name": "subtree", "kind": "verb", "oid": 2, "subtree": True}]})
    return policy.match_counts(policy.bind(a.objects.sparkSession, rules, a, b))


@query(
    "contents_without_dead",
    f"""WITH {O}, g AS (SELECT id FROM o WHERE contains(lower(name), 'velvet')), x AS (SELECT id, list(n ORDER BY i) AS l FROM (SELECT id, unnest(contents) AS n, unnest(range(1, len(contents) + 1)) AS i FROM o) WHERE n NOT IN (SELECT id FROM g) GROUP BY id)
SELECT o.id, CASE WHEN contents IS NOT NULL THEN coalesce(array_to_string(x.l, ','), '') END AS contents FROM o LEFT JOIN x ON x.id = o.id""",
)
def _(w):
    gone = w.objects.filter(F.contains(F.lower("name"), F.lit("velvet"))).select("id")
    return rewrite.without_dead(w, gone).select("id", F.when(F.col("contents").isNotNull(), F.concat_ws(",", F.col("contents").cast("array<string>"))).alias("contents"))


@query("renumbered_code")
def _(w):
    gone = w.objects.filter(F.contains(F.lower("name"), F.lit("velvet"))).select("id")
    return rewrite.renumbered_code(w, rewrite.renumbering(w, gone), -1_000_000)


@query("inherited_edges", f"""WITH RECURSIVE {O}, {P}, {SHOWN}, ip AS (SELECT oid, name, value_from, value_json FROM shown WHERE value_json IS NOT NULL), {_nodes("ip", "n2", "t2")}
SELECT holder_id AS src, scalar::BIGINT AS dst, 'inherited' AS kind, member || ':' || path AS evidence, value_from FROM t2 JOIN ip ON ip.oid = holder_id AND ip.name = member WHERE tag = 'obj'""")
def _(w):
    return G.effective_edges(w)


@query("numbers_in_code", f"""WITH {O}, {V}, {MASKED} SELECT DISTINCT oid, verb, line_no, id FROM (SELECT oid, verb, line_no, try_cast(unnest(regexp_extract_all(regexp_replace(' ' || seen || ' ', '([^A-Za-z0-9_.])', '\\1\\1', 'g'), '[^A-Za-z0-9_.]([0-9]+)[^A-Za-z0-9_.]', 1)) AS BIGINT) AS id FROM l) WHERE id IN (SELECT id FROM o)""")
def _(w):
    return export.numbers_in_code(w, w.objects.select("id"))


@query("list_edits", pair=True)
def _(a, b):
    return valuediff.list_edits(a, b)
