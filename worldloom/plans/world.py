"""Queries over one dump of a world: search, projection, references and censuses, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from worldloom.functions import moo
from worldloom.operators import inspect as I
from worldloom.plans.problems import _CANON, _NEWEST, _latest_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

O = f"o AS (SELECT * FROM {_latest_sql('moo_objects', 'snapshot_id, id')} WHERE snapshot_id = {_NEWEST})"
P = f"p AS (SELECT * FROM {_latest_sql('moo_properties', 'snapshot_id, oid, name')} WHERE snapshot_id = {_NEWEST})"
V = f"v AS (SELECT * FROM {_latest_sql('moo_verbs', 'snapshot_id, oid, name')} WHERE snapshot_id = {_NEWEST})"
LINES = "l AS (SELECT oid, verb_index, name AS verb, owner AS verb_owner, perms, unnest(range(1, len(code) + 1)) AS line_no, unnest(code) AS line FROM v)"
ALIASES = "a AS (SELECT oid, verb_index, name AS verb, perms, preps, alias FROM (SELECT *, unnest(string_split_regex(name, ' +')) AS alias FROM v) WHERE alias <> '')"
NODES = """n AS (SELECT oid AS holder_id, name AS member, '' AS path, value_json::JSON AS v FROM p WHERE value_json IS NOT NULL
    UNION ALL SELECT holder_id, member, CASE WHEN above = '' THEN seg ELSE above || '/' || seg END, v FROM (
      SELECT holder_id, member, path AS above, 'list:' || unnest(range(1, json_array_length(v, '$.items')::BIGINT + 1)) AS seg, unnest(json_extract(v, '$.items[*]')) AS v FROM n WHERE json_extract_string(v, '$.type') = 'list'
      UNION ALL SELECT holder_id, member, path, 'map:' || unnest(range(1, json_array_length(v, '$.entries')::BIGINT + 1)) || ':key', unnest(json_extract(v, '$.entries[*].key')) FROM n WHERE json_extract_string(v, '$.type') = 'map'
      UNION ALL SELECT holder_id, member, path, 'map:' || unnest(range(1, json_array_length(v, '$.entries')::BIGINT + 1)) || ':value', unnest(json_extract(v, '$.entries[*].value')) FROM n WHERE json_extract_string(v, '$.type') = 'map')),
  t AS (SELECT holder_id, member, path, json_extract_string(v, '$.type') AS tag, coalesce(json_extract_string(v, '$.value'), json_extract_string(v, '$.bits')) AS scalar FROM n)"""


def query(name: str, sql: str | None = None, back: int = 0):
    """Register a query over the opened dump and, if given, its SQL twin."""

    def register(f):
        def run(spark, sf):
            return f(I.open_world(spark, sf, back))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _flag_words(col: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {col} & {b} <> 0 THEN '{n}' END" for n, b in moo.OBJECT_FLAGS.items()) + "], lambda x: x IS NOT NULL), ' ')"


_STRINGS = r"""'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)'"""
#: Code lines with ``seen``, the line without the characters of string literals, which may run over several lines.
MASKED = f"""l AS (SELECT oid, verb_index, name AS verb, owner AS verb_owner, perms, unnest(range(1, len(code) + 1)) AS line_no, unnest(code) AS line, unnest(string_split(array_to_string(list_transform(list_zip(string_split_regex(t, {_STRINGS}), list_transform(regexp_extract_all(t, {_STRINGS}), lambda x: regexp_replace(x, '[^\n]', ' ', 'g'))), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), ''), chr(10))) AS seen
  FROM (SELECT *, array_to_string(list_transform(code, lambda x: coalesce(x, '')), chr(10)) AS t FROM v WHERE len(code) > 0))"""


def _args_sql(perms: str, preps: str) -> str:
    side = lambda s: f"coalesce(CASE ({perms} >> {s}) & 3 WHEN 0 THEN 'none' WHEN 1 THEN 'any' WHEN 2 THEN 'this' END, '?')"
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(moo.PREPOSITIONS))
    return f"({side(4)} || ' ' || CASE {preps} WHEN -2 THEN 'any' WHEN -1 THEN 'none' {cases} ELSE {preps}::VARCHAR END || ' ' || {side(6)})"


def _answers_sql(alias: str, word: str) -> str:
    a, w = f"lower({alias})", f"lower('{word}')"
    return f"(CASE WHEN NOT contains({a}, '*') THEN {a} = {w} ELSE length({w}) >= instr({a}, '*') - 1 AND (starts_with(replace({a}, '*', ''), {w}) OR (ends_with({a}, '*') AND starts_with({w}, replace({a}, '*', '')))) END)"


@query(
    "object_headers",
    f"""WITH {O}, {P}, {V} SELECT id, name, coalesce(nullif({_flag_words("flags")}, ''), '-') AS flag_words, owner, location, coalesce(len(parents), 0) AS n_parents, coalesce(len(children), 0) AS n_children, coalesce(len(contents), 0) AS n_contents,
  (SELECT count(*) FROM p WHERE p.oid = o.id) AS n_properties, (SELECT count(*) FROM v WHERE v.oid = o.id) AS n_verbs FROM o""",
)
def _(w):
    return I.headers(w)


@query(
    "builtin_properties",
    f"""WITH {O} SELECT id AS oid, u.name, u.value FROM (SELECT id, unnest([{{'name': 'name', 'value': name}}, {{'name': 'owner', 'value': owner::VARCHAR}}, {{'name': 'location', 'value': location::VARCHAR}},
  {", ".join(f"{{'name': '{n}', 'value': (coalesce(flags & {moo.OBJECT_FLAGS[f]}, 0) <> 0)::INT::VARCHAR}}" for n, f in (("programmer", "programmer"), ("wizard", "wizard"), ("r", "readable"), ("w", "writable"), ("f", "fertile")))}]) AS u FROM o)""",
)
def _(w):
    return I.builtins(w)


@query("grep_lines", f"WITH {V}, {LINES} SELECT oid, verb, line_no, line FROM l WHERE regexp_matches(line, 'return|raise')")
def _(w):
    return I.grep(w, "return|raise").select("oid", "verb", "line_no", "line")


@query(
    "grep_require_exclude",
    f"""WITH {V}, {LINES} SELECT oid, verb, line_no, line FROM l WHERE regexp_matches(line, 'this') AND EXISTS (SELECT 1 FROM v WHERE v.oid = l.oid AND v.name = l.verb AND perms & 4 <> 0
  AND len(list_filter(code, lambda x: regexp_matches(x, 'player:tell'))) > 0 AND len(list_filter(code, lambda x: regexp_matches(x, 'suspend'))) = 0)""",
)
def _(w):
    return I.grep(w, "this", ["player:tell"], ["suspend"], executable=True).select("oid", "verb", "line_no", "line")


@query("grep_code_only", f"""WITH {O}, {V}, {MASKED} SELECT oid, verb, line_no, line FROM l WHERE regexp_matches(seen, 'the|turn|E_') AND verb_owner IN (SELECT id FROM o WHERE flags & 4 <> 0)""")
def _(w):
    return I.grep(w, "the|turn|E_", code_only=True, wizard_owned=True).select("oid", "verb", "line_no", "line")


@query("grep_verb", f"""WITH {V}, {LINES}, {ALIASES} SELECT oid, verb, line_no, line FROM l WHERE regexp_matches(lower(line), 'return') AND (oid, verb) IN (SELECT (oid, verb) FROM a WHERE {_answers_sql("alias", "look")} OR {_answers_sql("alias", ":look")})""")
def _(w):
    """Matching lines, in any case, of the verbs that answer to a word."""
    return I.grep(w, "RETURN", verb="look", ignore_case=True).select("oid", "verb", "line_no", "line")


@query("grep_summary_by_owner", f"WITH {V}, {LINES} SELECT verb_owner, count(*) AS n_lines, count(DISTINCT (oid, verb)) AS n_verbs FROM l WHERE regexp_matches(line, 'return') GROUP BY verb_owner")
def _(w):
    return I.grep_summary(I.grep(w, "return"), "verb_owner")


@query("grep_summary", f"WITH {V}, {LINES} SELECT oid, count(*) AS n_lines, count(DISTINCT verb) AS n_verbs FROM l WHERE regexp_matches(line, 'return') GROUP BY oid")
def _(w):
    return I.grep_summary(I.grep(w, "return"))


@query(
    "grep_context",
    f"""WITH {V}, {LINES}, h AS (SELECT *, regexp_matches(line, 'suspend')::INT AS hit, max(regexp_matches(line, 'suspend')::INT) OVER (PARTITION BY oid, verb ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l)
SELECT oid, verb, line_no, line, hit, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY oid, verb ORDER BY line_no) <= 1 THEN 0 ELSE 1 END AS opens FROM h WHERE near = 1""",
)
def _(w):
    return I.grep_context(w, "suspend", 1)


@query("grep_without_match", f"WITH {V} SELECT oid, name FROM v WHERE len(code) > 0 AND len(list_filter(code, lambda x: regexp_matches(x, 'this'))) = 0")
def _(w):
    return I.without_match(w, "this")


@query("find_name", f"WITH {O} SELECT id, name FROM o WHERE contains(lower(name), 'lantern')")
def _(w):
    return w.objects.filter(F.contains(F.lower("name"), F.lit("lantern"))).select("id", "name")


@query("name_histogram", f"WITH {O} SELECT lower(name) AS name, count(*) AS n FROM o GROUP BY 1")
def _(w):
    return w.objects.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))


@query("find_verb", f"WITH {V}, {ALIASES} SELECT DISTINCT oid, verb, alias FROM a WHERE ({_answers_sql('alias', 'thro')} OR {_answers_sql('alias', ':thro')}) AND NOT regexp_matches(alias, '^[^A-Za-z0-9*]*\\*')")
def _(w):
    return I.verbs_answering(w, "thro", catch_alls=False)


@query("catch_all_verbs", f"WITH {V}, {ALIASES} SELECT DISTINCT oid, alias FROM a WHERE regexp_matches(alias, '^[^A-Za-z0-9*]*\\*')")
def _(w):
    return I.aliases(w).filter(moo.catch_all("alias")).select("oid", "alias").distinct()


@query("find_property", f"WITH {P} SELECT oid, name, slot FROM p WHERE lower(name) GLOB '*_l[io]*'")
def _(w):
    return w.properties.filter(F.lower("name").rlike(moo.glob("*_l[io]*"))).select("oid", "name", "slot")


@query("multi_parent", f"WITH {O} SELECT id, len(parents) AS n_parents FROM o WHERE len(parents) > 1")
def _(w):
    return w.objects.filter(F.size("parents") > 1).select("id", F.size("parents").alias("n_parents"))


@query("string_search", f"WITH RECURSIVE {P}, {NODES} SELECT holder_id, member, path, scalar FROM t WHERE tag = 'string' AND regexp_matches(scalar, 'garden$')")
def _(w):
    return I.value_nodes(w).filter((F.col("tag") == "string") & F.col("scalar").rlike("garden$")).select("holder_id", "member", "path", "scalar")


@query("value_kinds", f"WITH RECURSIVE {P}, {NODES} SELECT tag, count(*) AS n, count(*) FILTER (path = '') AS n_top FROM t GROUP BY tag")
def _(w):
    return I.value_nodes(w).groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("path") == "").alias("n_top"))


@query("value_truth", f"""WITH RECURSIVE {P}, {NODES} SELECT tag, count(*) AS n, sum(CASE tag WHEN 'int' THEN NOT regexp_matches(scalar, '^[-+]?0+$') WHEN 'float' THEN NOT regexp_matches(scalar, '^[08]0{{15}}$') WHEN 'string' THEN length(scalar) > 0 WHEN 'bool' THEN scalar = 'true' ELSE false END::INT)::BIGINT AS n_true
FROM t WHERE tag NOT IN ('list', 'map') GROUP BY tag""")
def _(w):
    t = I.value_nodes(w).filter(~F.col("tag").isin("list", "map"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.sum(moo.truth("tag", "scalar", F.lit(0)).cast("bigint")).alias("n_true"))


@query(
    "commands",
    f"""WITH {V}, c AS (SELECT oid, name, {_args_sql("perms", "preps")} AS args, code, list_position(list_transform(code, lambda x: regexp_matches(x, '^\\s*".*";\\s*$')), false) AS f FROM v)
SELECT oid, name, args, CASE WHEN code IS NULL THEN 0 WHEN f IS NULL OR f = 0 THEN len(code) ELSE f - 1 END AS n_comment_lines FROM c WHERE args <> 'this none this'""",
)
def _(w):
    return I.commands(w)


@query("verb_listing", f"""WITH {V} SELECT oid, verb_index, name, (CASE WHEN perms & 1 <> 0 THEN 'r' ELSE '' END || CASE WHEN perms & 2 <> 0 THEN 'w' ELSE '' END || CASE WHEN perms & 4 <> 0 THEN 'x' ELSE '' END || CASE WHEN perms & 8 <> 0 THEN 'd' ELSE '' END) AS letters,
  {_args_sql("perms", "preps")} AS args, len(code) AS n_lines FROM v""")
def _(w):
    return w.verbs.select("oid", "verb_index", "name", moo.letters("perms", moo.VERB_PERMS).alias("letters"), moo.verb_args("perms", "preps").alias("args"), F.when(F.col("code").isNotNull(), F.size("code")).alias("n_lines"))


_STAMP_SQL = """'^"Last modified \\w{3} (\\w{3}) +(\\d{1,2}) (\\d{2}:\\d{2}:\\d{2}) (\\d{4}) UTC by '"""


@query("verb_fingerprints", f"""WITH {V} SELECT oid, name, sha256(array_to_string(list_transform(code, lambda x: x || chr(10)), '')) AS digest, len(code) AS n_lines, CASE WHEN regexp_matches(code[-1], {_STAMP_SQL}) THEN strftime(try_strptime(regexp_extract(code[-1], {_STAMP_SQL}, 4) || ' ' || regexp_extract(code[-1], {_STAMP_SQL}, 1) || ' ' || regexp_extract(code[-1], {_STAMP_SQL}, 2) || ' ' || regexp_extract(code[-1], {_STAMP_SQL}, 3), '%Y %b %d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') END AS modified FROM v WHERE code IS NOT NULL""")
def _(w):
    return w.verbs.filter("code IS NOT NULL").select("oid", "name", moo.fingerprint("code").alias("digest"), F.size("code").alias("n_lines"), F.date_format(moo.modified("code"), "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query("clipped_lines", f"""WITH {V}, {LINES}, c AS (SELECT oid, verb, line_no, line, length(line) AS z, instr(line, regexp_extract(line, 'this|player')) - 1 AS hit FROM l WHERE regexp_matches(line, 'this|player')), d AS (SELECT *, greatest(0, least(hit - 15, z - 30)) AS s FROM c)
SELECT oid, verb, line_no, CASE WHEN z <= 30 THEN line ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(line, s + 1, 30) || '... [' || z || ' chars]' END AS shown FROM d""")
def _(w):
    return I.grep(w, "this|player").select("oid", "verb", "line_no", moo.clipped("line", 30, "this|player").alias("shown"))


@query("property_listing", f"""WITH {P} SELECT oid, slot, name, owner, (CASE WHEN perms & 1 <> 0 THEN 'r' ELSE '' END || CASE WHEN perms & 2 <> 0 THEN 'w' ELSE '' END || CASE WHEN perms & 4 <> 0 THEN 'c' ELSE '' END) AS letters, json_extract_string(value_json, '$.type') AS tag FROM p""")
def _(w):
    return w.properties.select("oid", "slot", "name", "owner", moo.letters("perms", moo.PROPERTY_PERMS).alias("letters"), I.tag().alias("tag"))


@query("stored_per_object", f"WITH {P} SELECT oid, count(*) AS n_stored FROM p WHERE coalesce(json_extract_string(value_json, '$.type') <> 'clear', true) GROUP BY oid")
def _(w):
    return I.stored(w).groupBy("oid").agg(F.count("*").alias("n_stored"))


@query("shared_values", f"WITH {P} SELECT name, count(*) AS n, min(oid) AS first_oid FROM (SELECT lower(name) AS name, oid, {_CANON} AS c FROM p WHERE value_json IS NOT NULL AND json_extract_string(value_json, '$.type') <> 'clear') GROUP BY name, c HAVING count(*) > 1")
def _(w):
    return I.same_values(w)


@query("largest_values", f"WITH {P} SELECT oid, name, length(json(value_json)::VARCHAR)::BIGINT AS size FROM p WHERE coalesce(json_extract_string(value_json, '$.type') <> 'clear', true) ORDER BY size DESC NULLS LAST, oid, name LIMIT 20")
def _(w):
    return I.largest_values(w, 20)


@query("find_references", f"WITH RECURSIVE {O}, {P}, {NODES} SELECT scalar::BIGINT AS target, holder_id, member, path FROM t WHERE tag = 'obj' AND scalar::BIGINT IN (SELECT id FROM o WHERE flags & 1 <> 0)")
def _(w):
    return I.references(w, w.objects.filter(moo.has_flag("flags", "player")).select("id"))


@query("code_mentions", f"""WITH {O}, {V}, {LINES} SELECT DISTINCT n::BIGINT AS target, oid, verb, line_no FROM (SELECT oid, verb, line_no, unnest(regexp_extract_all(' ' || line || ' ', '[^A-Za-z0-9_#$-]#([0-9]+)', 1)) AS n FROM l) WHERE n::BIGINT IN (SELECT id FROM o)""")
def _(w):
    return I.code_mentions(w)


@query("mention_places", f"""WITH {O}, {V}, {LINES} SELECT target, count(*) AS n_lines, count(DISTINCT oid) AS n_objects FROM (SELECT DISTINCT n::BIGINT AS target, oid, verb, line_no FROM (SELECT oid, verb, line_no, unnest(regexp_extract_all(' ' || line || ' ', '[^A-Za-z0-9_#$-]#([0-9]+)', 1)) AS n FROM l)) WHERE target IN (SELECT id FROM o) GROUP BY target""")
def _(w):
    return I.code_mentions(w).groupBy("target").agg(F.count("*").alias("n_lines"), F.count_distinct("oid").alias("n_objects"))


_BYTES = "(SELECT oid, sum(coalesce(list_sum(list_transform(code, lambda x: length(x) + 1)), 0))::BIGINT AS b FROM v GROUP BY oid)"
for _by, _key in (("owner", "owner"), ("location", "location"), ("parent", "parents[1]")):

    def _census(w, by=_by):
        return I.census(w, by)

    query(
        f"census_by_{_by}",
        f"""WITH {O}, {V}, k AS (SELECT id, {_key} AS key, coalesce(b, 0)::BIGINT AS b FROM o LEFT JOIN {_BYTES} s ON s.oid = o.id)
SELECT key, count(*) AS n_objects, sum(b)::BIGINT AS bytes, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM k GROUP BY key""",
    )(_census)


@query("slot_totals", f"""WITH RECURSIVE {O}, {P}, {V}, {NODES}, s AS (
    SELECT 'object' AS kind, 'owner' AS field, owner AS n FROM o UNION ALL SELECT 'object', 'location', location FROM o UNION ALL SELECT 'object', 'parents', unnest(parents) FROM o UNION ALL SELECT 'object', 'children', unnest(children) FROM o
    UNION ALL SELECT 'object', 'contents', unnest(contents) FROM o UNION ALL SELECT 'property', 'owner', owner FROM p UNION ALL SELECT 'verb', 'owner', owner FROM v UNION ALL SELECT 'property', 'value', scalar::BIGINT FROM t WHERE tag = 'obj')
SELECT kind, field, count(*) AS n_slots, count(*) FILTER (n < 0) AS n_negative, count(*) FILTER (n >= 0 AND n NOT IN (SELECT id FROM o)) AS n_missing FROM s WHERE n IS NOT NULL GROUP BY kind, field""")
def _(w):
    return I.slot_totals(w)


@query("key_kinds", f"WITH RECURSIVE {P}, {NODES} SELECT tag, count(*) AS n_keys FROM t WHERE path LIKE '%:key' GROUP BY tag")
def _(w):
    return I.key_kinds(w)


@query("dollar_names", f"WITH {P} SELECT oid, json_extract_string(value_json, '$.value')::BIGINT AS target, min_by(name, (slot, name)) AS dollar_name FROM p WHERE json_extract_string(value_json, '$.type') = 'obj' GROUP BY 1, 2")
def _(w):
    """What each object's properties name: #0 of the test world names nothing."""
    return I.dollar_names(w, None)


@query("waif_counts", f"WITH {O} SELECT waif_class, o.name AS class_name, n_waifs, n_without_props FROM (SELECT waif_class, count(*) AS n_waifs, count(*) FILTER (props IS NULL) AS n_without_props FROM (SELECT DISTINCT * FROM moo_waifs) GROUP BY waif_class) g LEFT JOIN o ON o.id = g.waif_class")
def _(w):
    return I.waif_counts(w)


@query("players", f"WITH {O} SELECT id, name, (owner IN (SELECT id FROM o))::INT AS owner_there, (location IN (SELECT id FROM o))::INT AS location_there FROM o WHERE flags & 1 <> 0")
def _(w):
    return I.players(w)


@query("recycled_numbers", f"WITH {O} SELECT range AS id FROM range(0, (SELECT max(id) FILTER (NOT coalesce(anon, false)) FROM o)) EXCEPT SELECT id FROM o")
def _(w):
    """Gaps among the numbers up to the greatest that is not anonymous."""
    top = w.objects.filter("NOT coalesce(anon, false)").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    span = top.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("id"), "m").filter("id < m").select("id")
    return span.join(w.objects.select("id"), "id", "left_anti")


@query("snapshot_info", f"""WITH {O}, {P}, {V} SELECT (SELECT count(*) FROM o) AS n_objects, (SELECT max(id) FROM o) AS max_id, (SELECT count(*) FROM o WHERE flags & 1 <> 0) AS n_players, (SELECT count(*) FROM o WHERE anon) AS n_anonymous,
  (SELECT count(*) FROM p) AS n_properties, (SELECT count(*) FROM v) AS n_verbs, (SELECT count(*) FROM v WHERE code IS NOT NULL) AS n_programs""")
def _(w):
    o = w.objects.agg(F.count("*").alias("n_objects"), F.max("id").alias("max_id"), F.count_if(moo.has_flag("flags", "player")).alias("n_players"), F.count_if("anon").alias("n_anonymous"))
    return o.crossJoin(w.properties.agg(F.count("*").alias("n_properties"))).crossJoin(w.verbs.agg(F.count("*").alias("n_verbs"), F.count("code").alias("n_programs")))


@query("literals", f"""WITH {O} SELECT id, '"' || replace(replace(name, '\\', '\\\\'), '"', '\\"') || '"' AS literal, regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM o""")
def _(w):
    return w.objects.select("id", moo.literal("name").alias("literal"), moo.file_name("name").alias("file_name"))


@query("last_moves", f"WITH {O} SELECT id, CASE WHEN last_move > 0 THEN strftime(to_timestamp(last_move) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS moved, id & 4294967295 AS low FROM o")
def _(w):
    return w.objects.select("id", moo.clock("last_move").alias("moved"), moo.low32("id").alias("low"))


@query("top_verbs_per_owner", f"WITH {V} SELECT owner, oid, name, n_lines FROM (SELECT owner, oid, name, len(code)::BIGINT AS n_lines, row_number() OVER (PARTITION BY owner ORDER BY len(code) DESC, oid, name) AS r FROM v WHERE code IS NOT NULL) WHERE r <= 3")
def _(w):
    """The three longest verbs of each owner (a top-k report)."""
    from pyspark.sql import Window

    by = Window.partitionBy("owner").orderBy(F.desc("n_lines"), "oid", "name")
    v = w.verbs.filter("code IS NOT NULL").select("owner", "oid", "name", F.size("code").cast("bigint").alias("n_lines"))
    return v.withColumn("r", F.row_number().over(by)).filter("r <= 3").drop("r")


@query("rank_candidates", f"WITH {O}, {V} SELECT id, n_verbs, n_children FROM (SELECT id, (flags & 128 <> 0) AS fertile, (SELECT count(*) FROM v WHERE v.oid = o.id) AS n_verbs, coalesce(len(children), 0) AS n_children FROM o) ORDER BY fertile NULLS FIRST, n_verbs DESC, n_children DESC, id LIMIT 50")
def _(w):
    """The 50 most programmed objects, infertile ones first (a top-k report)."""
    h = I.headers(w).join(w.objects.select("id", moo.has_flag("flags", "fertile").alias("fertile")), "id")
    return h.orderBy("fertile", F.desc("n_verbs"), F.desc("n_children"), "id").limit(50).select("id", "n_verbs", "n_children")


@query("code_offsets", f"""WITH {V} SELECT oid, verb_index, name, (sum(coalesce(list_sum(list_transform(code, lambda x: length(x) + 1)), 0)) OVER (PARTITION BY oid ORDER BY verb_index, name ROWS UNBOUNDED PRECEDING) - coalesce(list_sum(list_transform(code, lambda x: length(x) + 1)), 0))::BIGINT AS start FROM v""")
def _(w):
    """Where each verb's program starts in its object's source text."""
    from pyspark.sql import Window

    size = F.coalesce(F.aggregate("code", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x) + 1), F.lit(0))
    by = Window.partitionBy("oid").orderBy("verb_index", "name")
    return w.verbs.select("oid", "verb_index", "name", size.alias("size")).withColumn("start", F.sum("size").over(by) - F.col("size")).drop("size")


@query("string_mentions", f"WITH RECURSIVE {O}, {P}, {NODES} SELECT try_cast(n AS BIGINT) AS target, holder_id, member, count(*) AS n FROM (SELECT holder_id, member, unnest(regexp_extract_all(scalar, '#([0-9]+)', 1)) AS n FROM t WHERE tag = 'string') WHERE try_cast(n AS BIGINT) IN (SELECT id FROM o) GROUP BY ALL")
def _(w):
    return I.string_mentions(w)


@query("missing_by_number", f"""WITH RECURSIVE {O}, {P}, {V}, {NODES}, s AS (
    SELECT owner AS n FROM o UNION ALL SELECT location FROM o UNION ALL SELECT unnest(parents) FROM o UNION ALL SELECT unnest(children) FROM o
    UNION ALL SELECT unnest(contents) FROM o UNION ALL SELECT owner FROM p UNION ALL SELECT owner FROM v UNION ALL SELECT scalar::BIGINT FROM t WHERE tag = 'obj')
SELECT n AS number, count(*) AS n_missing FROM s WHERE n >= 0 AND n NOT IN (SELECT id FROM o) GROUP BY n""")
def _(w):
    return I.missing_by(w, "number")


@query("chosen_objects", f"WITH {O} SELECT id FROM o WHERE id IN (1, 2, 3) OR owner = 10 OR regexp_matches(name, '^Amber')")
def _(w):
    return I.chosen(w, [1, 2, 3], 10, "^Amber")
