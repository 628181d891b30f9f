"""Registered queries of the general problems: regular grid (2), drifting schemas (3), implausible readings (5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.regular_grid import missing_slots, regular_grid
from ..operators.schema_drift import ALIASES, as_json, path_alternatives, schema_changes, unified_table
from ..operators.spikes import implausible_readings
from ..sources.tables import table


def _grid(spark, sf):
    return regular_grid(table(spark, sf, "result_table"), table(spark, sf, "positions"))


def _changes(spark, sf):
    return schema_changes(table(spark, sf, "raw_results"), table(spark, sf, "field_catalogue"))


def p2_found(spark, sf):
    return missing_slots(_grid(spark, sf))


def p2_grid(spark, sf):
    return _grid(spark, sf)


def p3_found(spark, sf):
    return _changes(spark, sf).select("file_no", "field", "change")


def p3_report(spark, sf):
    return _changes(spark, sf)


def p3_unified(spark, sf):
    """The unified table; ``other``, the fields outside the catalogue, as the text of a JSON object sorted by key."""
    return unified_table(table(spark, sf, "raw_results"), table(spark, sf, "field_catalogue")).withColumn("other", as_json(F.col("other")))


def p3_paths(spark, sf):
    """Every alternative of every path, nested ones too."""
    return path_alternatives(table(spark, sf, "raw_results"), table(spark, sf, "field_catalogue"))


def p5_found(spark, sf):
    found = implausible_readings(table(spark, sf, "result_table"), table(spark, sf, "positions"))
    return found.select("row_id", "field").distinct()


def p5_report(spark, sf):
    found = implausible_readings(table(spark, sf, "result_table"), table(spark, sf, "positions"))
    return found.groupBy("pos", "field", "reason").agg(F.count(F.lit(1)).alias("n_readings"))


QUERIES = {f.__name__: f for f in (p2_found, p2_grid, p3_found, p3_report, p3_unified, p3_paths, p5_found, p5_report)}

#: SQL (NaN by its text, as isnan() of some DuckDB versions trusts statistics that leave NaN out): unit by the level of timepoint against the plan; a first frame has the unit of the earliest numbered one after it
_SLOTS = """WITH p AS (SELECT pos, max(interval_s) AS iv FROM positions GROUP BY pos), r AS (SELECT r.pos, meta_t, CASE WHEN CAST(timepoint AS VARCHAR) <> 'nan' THEN timepoint END AS tp, iv,
  coalesce(CAST(covered_ratio AS VARCHAR) <> 'nan' AND CAST(graph_edge_length AS VARCHAR) <> 'nan', false) AS ok FROM result_table r JOIN p USING (pos)),
u AS (SELECT *, CASE WHEN meta_t > 0 AND tp > 0 THEN list_sort([(abs(ln(tp / (meta_t * iv) * f)), f) FOR f IN [1.0, 0.001, 60.0, 3600.0]])[1][2] END AS unit FROM r),
z AS (SELECT pos, arg_min(unit, meta_t) AS first_unit FROM u WHERE unit IS NOT NULL GROUP BY pos),
s AS (SELECT DISTINCT u.pos, CAST(floor(tp * coalesce(unit, first_unit, 1.0) / iv + 0.5) AS BIGINT) AS slot FROM u LEFT JOIN z ON u.pos = z.pos WHERE ok AND tp IS NOT NULL),
b AS (SELECT pos, min(slot) AS a, max(slot) AS e FROM s GROUP BY pos), g AS (SELECT pos, unnest(range(a, e + 1)) AS slot FROM b)"""

_NAMES = ", ".join(f"('{alias}', '{field}')" for field, more in ALIASES.items() for alias in more)
_FILES = f"""WITH n(folded, field) AS (VALUES {_NAMES}), r AS (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS p FROM raw_results),
k AS (SELECT station, file_no, written_at, p, unnest(json_keys(p)) AS name FROM r WHERE p IS NOT NULL),
v AS (SELECT k.*, coalesce(c.field, n.field, k.name) AS field, CASE json_type(p, '$."' || name || '"') WHEN 'BIGINT' THEN 'whole' WHEN 'UBIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'fraction' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS kind
  FROM k LEFT JOIN n ON n.folded = regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LEFT JOIN field_catalogue c ON regexp_replace(lower(c.field), '[^a-z0-9]', '', 'g') = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')),
s AS (SELECT station, file_no, field, string_agg(DISTINCT name, '|' ORDER BY name) AS names, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM v GROUP BY station, file_no, field),
f AS (SELECT station, file_no, min(written_at) AS w FROM raw_results GROUP BY station, file_no), o AS (SELECT *, lag(file_no) OVER (PARTITION BY station ORDER BY w, file_no) AS before_no FROM f),
sk AS (SELECT s.station, s.file_no, s.field, lag(kinds) OVER (PARTITION BY s.station, s.field ORDER BY w, s.file_no) AS old_kinds FROM s JOIN f USING (station, file_no) WHERE kinds IS NOT NULL),
now AS (SELECT o.file_no, s.field, s.names, s.kinds FROM o JOIN s ON s.station = o.station AND s.file_no = o.file_no WHERE before_no IS NOT NULL),
old AS (SELECT o.file_no, s.field, s.names AS old_names FROM o JOIN s ON s.station = o.station AND s.file_no = o.before_no WHERE before_no IS NOT NULL),
j AS (SELECT coalesce(now.file_no, old.file_no) AS file_no, coalesce(now.field, old.field) AS field, names, kinds, old_names FROM now FULL JOIN old ON now.file_no = old.file_no AND now.field = old.field),
x AS (SELECT j.*, sk.old_kinds FROM j LEFT JOIN sk ON sk.file_no = j.file_no AND sk.field = j.field),
c AS (SELECT file_no, field, 'added' AS change, CAST(NULL AS VARCHAR) AS "old", names AS "new" FROM x WHERE old_names IS NULL UNION ALL SELECT file_no, field, 'removed', old_names, NULL FROM x WHERE names IS NULL
  UNION ALL SELECT file_no, field, 'renamed', old_names, names FROM x WHERE names <> old_names UNION ALL SELECT file_no, field, 'retyped', old_kinds, kinds FROM x WHERE names IS NOT NULL AND old_names IS NOT NULL AND kinds <> old_kinds)"""

#: SQL: paths of a JSON tree, indices of lists as [], the first name as its field
_PATHS = f"""WITH n(folded, field) AS (VALUES {_NAMES}), r AS (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS p FROM raw_results),
k AS (SELECT station, file_no, written_at, p, unnest(json_keys(p)) AS name FROM r WHERE p IS NOT NULL),
v AS (SELECT k.station, k.file_no, k.written_at, coalesce(c.field, n.field, k.name) AS field, json_extract(p, '$."' || name || '"') AS j
  FROM k LEFT JOIN n ON n.folded = regexp_replace(lower(name), '[^a-z0-9]', '', 'g') LEFT JOIN field_catalogue c ON regexp_replace(lower(c.field), '[^a-z0-9]', '', 'g') = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')),
t AS (SELECT v.station, v.file_no, v.written_at, v.field || regexp_replace(regexp_replace(substr(e.fullkey, 2), '\\[[0-9]+\\]', '[]', 'g'), '"', '', 'g') AS path,
  CASE e.type WHEN 'BIGINT' THEN 'whole' WHEN 'UBIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'fraction' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS kind FROM v, json_tree(v.j) e)
SELECT station, path, kind, count(*) AS n_values, count(DISTINCT file_no) AS n_files, arg_min(file_no, (written_at, file_no)) AS first_file_no FROM t WHERE kind IS NOT NULL GROUP BY station, path, kind"""

ORACLES: dict[str, str] = {
    "p3_paths": _PATHS,
    "p2_found": f"{_SLOTS} SELECT pos, slot FROM g EXCEPT SELECT pos, slot FROM s",
    "p3_found": f"{_FILES} SELECT file_no, field, change FROM c",
    "p3_report": f"{_FILES} SELECT file_no, field, change, \"old\", \"new\" FROM c",
}
