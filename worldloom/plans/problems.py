"""Queries of the data problems that live in the core, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldloom.functions.values import canonical, code_text
from worldloom.operators import hierarchy as H
from worldloom.operators import nested, snapshots
from worldloom.operators.reconcile import Copies, reconcile_all
from worldloom.sources.tables import MEMBER_KEY, OBJECT_KEY, latest, live_dumps, mirror_dump, table


def newest_objects(spark: SparkSession, sf: str) -> DataFrame:
    dumps = live_dumps(table(spark, sf, "moo_dumps"))
    rows = table(spark, sf, "moo_objects").filter(F.col("snapshot_id") == (dumps[-1] if dumps else None))
    return latest(rows, OBJECT_KEY, ["parents"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return H.hierarchy(newest_objects(spark, sf))


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    return H.paths(newest_objects(spark, sf)).select("id", "root_id", "depth", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendants(H.paths(newest_objects(spark, sf)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    dumps = table(spark, sf, "moo_dumps")
    live, mirror = live_dumps(dumps), mirror_dump(dumps)
    value = {"object": {f: F.col(f) for f in ("name", "flags", "owner")}, "property": {"value": canonical("value_json"), "perms": F.col("perms")}, "verb": {"code": code_text("code"), "perms": F.col("perms")}}
    copies = []
    for kind, fields in value.items():
        t = table(spark, sf, {"object": "moo_objects", "property": "moo_properties", "verb": "moo_verbs"}[kind])
        a, b = (t.filter(F.col("snapshot_id") == s) for s in (live[-1] if live else None, mirror))
        copies.append(Copies(a, b, ["id"] if kind == "object" else ["oid", "name"], fields))
    parts = [d.select(F.lit(kind).alias("kind"), F.col(c.key[0]).alias("oid"), F.lit("").alias("name") if kind == "object" else F.col("name"), "difference") for kind, c, d in zip(value, copies, reconcile_all(copies))]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.member_changes(table(spark, sf, "moo_properties"), table(spark, sf, "moo_verbs"), live_dumps(table(spark, sf, "moo_dumps")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.attribute_versions(table(spark, sf, "moo_objects"), live_dumps(table(spark, sf, "moo_dumps")))


def _p7_values(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    dumps = live_dumps(table(spark, sf, "moo_dumps"))
    rows = table(spark, sf, "moo_properties").filter(F.col("snapshot_id") == (dumps[-1] if dumps else None))
    props = latest(rows, MEMBER_KEY, ["value_json"]).select(F.lit("property").alias("holder_kind"), F.col("oid").alias("holder_id"), F.col("name").alias("member"), F.col("value_json").alias("text"))
    waifs = table(spark, sf, "moo_waifs").select("waif_index", "props").distinct().select(F.lit("waif").alias("holder_kind"), F.col("waif_index").alias("holder_id"), F.lit(None).cast("string").alias("member"), F.col("props").alias("text"))
    # Scalars have no nodes below the top; their texts hold no bracketed member and need not reach Python.
    return props.filter(F.col("text").contains("[")), waifs


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    props, waifs = _p7_values(spark, sf)
    return nested.flatten_values(props, "value").unionByName(nested.flatten_values(waifs, "slots"))


def p7_linked(spark: SparkSession, sf: str) -> DataFrame:
    props, waifs = _p7_values(spark, sf)
    return nested.flatten_values(props, "value", linked=True).unionByName(nested.flatten_values(waifs, "slots", linked=True))


def p6_history(spark: SparkSession, sf: str) -> DataFrame:
    out = snapshots.attribute_versions(table(spark, sf, "moo_objects"), live_dumps(table(spark, sf, "moo_dumps")), with_values=True)
    return out.withColumn("parents", F.concat_ws(",", F.col("parents").cast("array<string>")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_history": p6_history,
    "p7_found": p7_found,
    "p7_linked": p7_linked,
}

_LIVE = "SELECT snapshot_id, row_number() OVER (ORDER BY taken_at) AS i FROM moo_dumps WHERE world = 'live'"
_NEWEST = "(SELECT snapshot_id FROM moo_dumps WHERE world = 'live' ORDER BY taken_at DESC LIMIT 1)"
_MIRROR = "(SELECT snapshot_id FROM moo_dumps WHERE world = 'mirror' ORDER BY taken_at DESC LIMIT 1)"


def _latest_sql(t: str, key: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC NULLS LAST) AS rn FROM {t}) WHERE rn = 1)"


_FIRST_PARENT = f"""
  objs AS (SELECT id, parents FROM {_latest_sql("moo_objects", "snapshot_id, id")} WHERE snapshot_id = {_NEWEST}),
  links AS (SELECT o.id, o.p, o.pos FROM (SELECT id, unnest(parents) AS p, unnest(range(1, len(parents) + 1)) AS pos FROM objs) o WHERE o.p IN (SELECT id FROM objs)),
  up AS (SELECT o.id, min_by(l.p, l.pos) AS p FROM objs o LEFT JOIN links l ON o.id = l.id GROUP BY o.id),
  walk AS (SELECT id, id AS root_id, 0 AS depth, [id] AS path FROM up WHERE p IS NULL
           UNION ALL SELECT u.id, w.root_id, w.depth + 1, list_append(w.path, u.id) FROM up u JOIN walk w ON u.p = w.id)"""

_ANY_PARENT = """
  reach(a, b) AS (SELECT id, p FROM links UNION SELECT r.a, l.p FROM reach r JOIN links l ON r.b = l.id)"""

#: One spelling per value: its JSON tree's leaves and containers by full path.
_CANON = "(SELECT string_agg(fullkey || '=' || type || ':' || CASE WHEN type = 'VARCHAR' THEN json_extract_string(value_json, fullkey) ELSE coalesce(atom::VARCHAR, '') END, chr(10) ORDER BY fullkey) FROM json_tree(value_json))"


def _member_sql(t: str, where: str, value: str) -> str:
    return f"(SELECT snapshot_id, oid, name, perms, {value} AS v FROM {_latest_sql(t, 'snapshot_id, oid, name')} WHERE {where})"


def _missing_sql(kind: str, a: str, b: str, key: str, oid: str, name: str, fields: dict[str, str]) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in key.split(", "))
    parts = [
        f"SELECT '{kind}' AS kind, a.{oid} AS oid, {name.format('a')} AS name, 'missing_in_mirror' AS difference FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE {on})",
        f"SELECT '{kind}', b.{oid}, {name.format('b')}, 'missing_in_live' FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE {on})",
    ]
    parts += [f"SELECT '{kind}', a.{oid}, {name.format('a')}, '{f}' FROM {a} a JOIN {b} b ON {on} WHERE a.{c} IS DISTINCT FROM b.{c}" for f, c in fields.items()]
    return " UNION ALL ".join(parts)


def _changes_sql(kind: str, t: str) -> str:
    pair = "a.oid = b.oid AND a.name = b.name"
    return f"""SELECT '{kind}' AS kind, d.snapshot_id, m.oid, m.name, 'added' AS change_type FROM live d JOIN {t} m ON m.snapshot_id = d.snapshot_id WHERE d.i > 1
  AND NOT EXISTS (SELECT 1 FROM {t} p JOIN live e ON p.snapshot_id = e.snapshot_id AND e.i = d.i - 1 WHERE p.oid = m.oid AND p.name = m.name)
UNION ALL SELECT '{kind}', n.snapshot_id, m.oid, m.name, 'removed' FROM live d JOIN {t} m ON m.snapshot_id = d.snapshot_id JOIN live n ON n.i = d.i + 1
  WHERE NOT EXISTS (SELECT 1 FROM {t} p WHERE p.snapshot_id = n.snapshot_id AND p.oid = m.oid AND p.name = m.name)
UNION ALL SELECT '{kind}', e.snapshot_id, b.oid, b.name, 'changed' FROM live d JOIN {t} a ON a.snapshot_id = d.snapshot_id JOIN live e ON e.i = d.i + 1
  JOIN {t} b ON b.snapshot_id = e.snapshot_id AND {pair} WHERE a.v IS DISTINCT FROM b.v"""


_LIVE_ONLY = "snapshot_id IN (SELECT snapshot_id FROM moo_dumps WHERE world = 'live')"
_TAG = "json_extract_string(v, '$.type')"


def _nodes_sql(linked: bool) -> str:
    more = ", parent_path, CASE WHEN t NOT IN ('list', 'map') THEN coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.bits')) END AS scalar" if linked else ""
    return f"""WITH RECURSIVE tops AS (
    SELECT 'property' AS holder_kind, oid AS holder_id, name AS member, value_json::JSON AS v FROM {_latest_sql("moo_properties", "snapshot_id, oid, name")} WHERE snapshot_id = {_NEWEST} AND json_valid(value_json)
    UNION ALL SELECT 'waif', waif_index, json_extract_string(s, '$[0]'), json_extract(s, '$[1]') FROM (SELECT waif_index, unnest(json_extract(props, '$[*]')) AS s FROM (SELECT DISTINCT waif_index, props FROM moo_waifs WHERE json_valid(props)))),
  n AS (SELECT holder_kind, holder_id, member, '' AS path, '' AS parent_path, v, {_TAG} AS t FROM tops
    UNION ALL SELECT holder_kind, holder_id, member, CASE WHEN above = '' THEN seg ELSE above || '/' || seg END, above, v, {_TAG} FROM (
      SELECT holder_kind, holder_id, member, path AS above, 'list:' || unnest(range(1, json_array_length(v, '$.items')::BIGINT + 1)) AS seg, unnest(json_extract(v, '$.items[*]')) AS v FROM n WHERE t = 'list'
      UNION ALL SELECT holder_kind, holder_id, member, path, 'map:' || unnest(range(1, json_array_length(v, '$.entries')::BIGINT + 1)) || ':key', unnest(json_extract(v, '$.entries[*].key')) FROM n WHERE t = 'map'
      UNION ALL SELECT holder_kind, holder_id, member, path, 'map:' || unnest(range(1, json_array_length(v, '$.entries')::BIGINT + 1)) || ':value', unnest(json_extract(v, '$.entries[*].value')) FROM n WHERE t = 'map'))
SELECT holder_kind, holder_id, member, path, t AS tag{more} FROM n WHERE path <> ''"""


ORACLES: dict[str, str] = {
    "p3_found": f"""WITH oa AS (SELECT * FROM {_latest_sql("moo_objects", "snapshot_id, id")} WHERE snapshot_id = {_NEWEST}), ob AS (SELECT * FROM {_latest_sql("moo_objects", "snapshot_id, id")} WHERE snapshot_id = {_MIRROR}),
  pa AS {_member_sql("moo_properties", f"snapshot_id = {_NEWEST}", _CANON)}, pb AS {_member_sql("moo_properties", f"snapshot_id = {_MIRROR}", _CANON)},
  va AS {_member_sql("moo_verbs", f"snapshot_id = {_NEWEST}", "code")}, vb AS {_member_sql("moo_verbs", f"snapshot_id = {_MIRROR}", "code")}
{_missing_sql("object", "oa", "ob", "id", "id", "''", {"name": "name", "flags": "flags", "owner": "owner"})}
UNION ALL {_missing_sql("property", "pa", "pb", "oid, name", "oid", "{}.name", {"value": "v", "perms": "perms"})}
UNION ALL {_missing_sql("verb", "va", "vb", "oid, name", "oid", "{}.name", {"code": "v", "perms": "perms"})}""",
    "p4_found": f"""WITH live AS ({_LIVE}), p AS {_member_sql("moo_properties", _LIVE_ONLY, _CANON)}, v AS {_member_sql("moo_verbs", _LIVE_ONLY, "code")}
{_changes_sql("property", "p")}
UNION ALL {_changes_sql("verb", "v")}""",
    "p7_found": _nodes_sql(False),
    "p7_linked": _nodes_sql(True),
    "p6_history": f"""WITH live AS ({_LIVE}),
  o AS (SELECT id, i, snapshot_id, name, owner, location, coalesce(parents, []) AS ps, parents FROM {_latest_sql("moo_objects", "snapshot_id, id")} JOIN live USING (snapshot_id)),
  m AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(name) OVER w IS NOT DISTINCT FROM name AND lag(owner) OVER w IS NOT DISTINCT FROM owner AND lag(location) OVER w IS NOT DISTINCT FROM location AND lag(ps) OVER w = ps THEN 0 ELSE 1 END AS starts
        FROM o WINDOW w AS (PARTITION BY id ORDER BY i)),
  g AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS v FROM m)
SELECT id, min_by(snapshot_id, i) AS first_snapshot_id, max_by(snapshot_id, i) AS last_snapshot_id, arg_min_null(name, i) AS name, arg_min_null(owner, i) AS owner, arg_min_null(location, i) AS location,
  coalesce(array_to_string(arg_min(ps, i), ','), '') AS parents FROM g GROUP BY id, v""",
    "p2_found": f"""WITH RECURSIVE {_FIRST_PARENT}, {_ANY_PARENT}
SELECT u.id, coalesce(w.root_id, -1) AS root_id, coalesce(w.depth, -1) AS depth, CASE WHEN u.id IN (SELECT a FROM reach WHERE a = b) THEN 1 ELSE 0 END AS on_cycle
FROM up u LEFT JOIN walk w ON u.id = w.id""",
    "p2_paths": f"""WITH RECURSIVE {_FIRST_PARENT}
SELECT u.id, coalesce(w.root_id, -1) AS root_id, coalesce(w.depth, -1) AS depth, coalesce(array_to_string(w.path, '/'), '') AS path FROM up u LEFT JOIN walk w ON u.id = w.id""",
    "p2_descendants": f"""WITH RECURSIVE {_FIRST_PARENT}
SELECT a AS ancestor_id, id, (depth + 1 - pos)::INT AS distance FROM (SELECT id, depth, unnest(path) AS a, unnest(range(1, depth + 2)) AS pos FROM walk) WHERE pos <= depth""",
    "p6_found": f"""WITH live AS ({_LIVE}),
  o AS (SELECT id, i, snapshot_id, [coalesce('=' || name, '~'), coalesce(owner::VARCHAR, '~'), coalesce(location::VARCHAR, '~')] AS a, coalesce(parents, []) AS ps
        FROM {_latest_sql("moo_objects", "snapshot_id, id")} JOIN live USING (snapshot_id)),
  m AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(a) OVER w = a AND lag(ps) OVER w = ps THEN 0 ELSE 1 END AS starts FROM o WINDOW w AS (PARTITION BY id ORDER BY i)),
  g AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY i) AS v FROM m)
SELECT id, min_by(snapshot_id, i) AS first_snapshot_id, max_by(snapshot_id, i) AS last_snapshot_id FROM g GROUP BY id, v""",
}
