"""Registered queries of the frame, track, regression and result operators, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Tunables, thresholding_parameters
from ..functions import names
from ..functions.regression import p_value
from ..kernels import raster
from ..operators import frames as fr
from ..operators import tracks as tr
from ..operators import graphs as gr
from ..operators import results as rs
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df, digits: int = 6):
    """Doubles rounded, minus zero as zero, for results that two engines must agree on."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _fin(c: str) -> str:
    """SQL: the value, null where it is NaN or infinite."""
    return f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


#: digits to which two engines' floating-point sums agree
DIGITS = {"slope": 8, "intercept": 4, "rvalue": 8, "stderr": 8, "intercept_stderr": 3}


def _fit(x: str, y: str, guard: str = "") -> str:
    """SQL: the parts of a least-squares fit, rounded; ``guard`` is a condition under which all are null."""
    n, sxx, sxy, syy = (f"{f}({y}, {x})" for f in ("regr_count", "regr_sxx", "regr_sxy", "regr_syy"))
    slope = f"({sxy} / nullif({sxx}, 0))"
    r = f"CASE WHEN {sxx} * {syy} > 0 THEN greatest(-1.0, least(1.0, {sxy} / nullif(sqrt({sxx} * {syy}), 0))) END"
    rest = f"CASE WHEN {n} > 2 THEN sqrt((1 - coalesce({r}, 0) ** 2) * {syy} / nullif({sxx} * ({n} - 2), 0)) WHEN {sxx} > 0 THEN 0.0 END"
    parts = {"slope": slope, "intercept": f"(regr_avgy({y}, {x}) - {slope} * regr_avgx({y}, {x}))", "rvalue": r, "stderr": rest, "intercept_stderr": f"(({rest}) * sqrt({sxx} / {n} + regr_avgx({y}, {x}) ** 2))"}
    ok = f"{n} >= 2" + (f" AND NOT ({guard})" if guard else "")
    return ", ".join(f"round(CASE WHEN {ok} THEN {e} END, {DIGITS[k]}) + 0.0 AS {k}" for k, e in parts.items())


def _fits(df):
    return df.select(*[(F.round(c, DIGITS.get(c, 8)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- regressions and tracks ---------------------------------------------------------------------------------------
STEPS = f"""steps AS (SELECT DISTINCT pos, track_id, i, timepoint, node_id_a, node_id_b, node_next_id_a, node_next_id_b, {_fin('distance')} AS distance, distance_num
  FROM track_steps WHERE {_fin('distance')} IS NOT NULL)"""
TRACKS = f"""{STEPS}, tracks AS (SELECT pos, track_id, min(timepoint) AS timepoint_begin, max(timepoint) AS timepoint_end, min(distance) AS minimum_distance, max(distance) AS maximum_distance,
  min(distance_num) AS minimum_distance_num, max(distance_num) AS maximum_distance_num, count(*) AS "count",
  max(distance) - min(distance) AS grown FROM steps GROUP BY pos, track_id),
kept AS (SELECT *, timepoint_begin + (timepoint_end - timepoint_begin) / 2 AS timepoint_center, timepoint_end - timepoint_begin AS duration FROM tracks
  WHERE "count" >= 5 AND maximum_distance >= 10 AND grown >= 5 AND grown <> 0)"""


def _steps(spark, sf):
    return tr.clean_steps(table(spark, sf, "track_steps"))


@query(f"""WITH fin AS (SELECT pos, {_fin('timepoint')} AS x, {_fin('graph_edge_length')} AS y FROM result_table),
ok AS (SELECT * FROM fin WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT pos, 'graph_edge_length' AS field, 'linear' AS scale, count(*) AS n, {_fit('x', 'y')} FROM ok GROUP BY pos""")
def regress_position(spark, sf):
    """Growth of the edge length per position."""
    x = tr.position_regressions(table(spark, sf, "result_table").select("pos", "timepoint", *tr.POSITION_FIELDS)).where("field = 'graph_edge_length' and scale = 'linear'")
    return _fits(x)


_LOG = "CASE WHEN v > 0 THEN ln(v) ELSE CAST('-infinity' AS DOUBLE) END"
_POS_LONG = " UNION ALL ".join(f"SELECT pos, {_fin('timepoint')} AS x, '{f}' AS field, {_fin(f)} AS v FROM result_table" for f in tr.POSITION_FIELDS)


@query(f"""WITH l AS ({_POS_LONG}), s AS (SELECT pos, x, field, 'linear' AS scale, v AS y FROM l WHERE v IS NOT NULL UNION ALL SELECT pos, x, field, 'logarithmic', {_LOG} FROM l WHERE v IS NOT NULL),
ok AS (SELECT *, CASE WHEN isfinite(y) THEN y END AS yf, isinf(y) AS bad FROM s WHERE x IS NOT NULL)
SELECT pos, field, scale, CASE WHEN NOT bool_or(bad) THEN count(*) END AS n, {_fit('x', 'yf', guard='bool_or(bad)')} FROM ok GROUP BY pos, field, scale""")
def regress_position_all(spark, sf):
    """All fields, linear and logarithmic."""
    return _fits(tr.position_regressions(table(spark, sf, "result_table")))


@query("WITH l AS (" + _POS_LONG + "), ok AS (SELECT pos, field, x, v FROM l WHERE x IS NOT NULL AND v IS NOT NULL) SELECT pos, "
       + ", ".join(f"round(max(CASE WHEN field = '{f}' AND scale = '{s}' THEN slope END), 8) + 0.0 AS {f}_{s}_regression_slope" for f in tr.POSITION_FIELDS for s in ("linear", "logarithmic"))
       + " FROM (SELECT pos, field, 'linear' AS scale, regr_sxy(v, x) / nullif(regr_sxx(v, x), 0) AS slope FROM ok GROUP BY pos, field HAVING count(*) >= 2 UNION ALL"
         " SELECT pos, field, 'logarithmic', CASE WHEN min(v) > 0 THEN regr_sxy(ln(CASE WHEN v > 0 THEN v END), x) / nullif(regr_sxx(ln(CASE WHEN v > 0 THEN v END), x), 0) END FROM ok GROUP BY pos, field) GROUP BY pos")  # fmt: skip
def regress_wide(spark, sf):
    return _fits(tr.position_regressions_wide(table(spark, sf, "result_table")))


@query(f"WITH {STEPS} SELECT pos, track_id, count(*) AS n, {_fit('timepoint', 'distance')} FROM steps GROUP BY pos, track_id")
def regress_plain(spark, sf):
    s = _steps(spark, sf)
    return _fits(s.groupBy("pos", "track_id").agg(*[c.alias(k) for k, c in tr.linregress(F.col("timepoint"), F.col("distance")).items()]))


@query(f"""WITH {TRACKS}, j AS (SELECT s.pos, s.track_id, s.timepoint AS x, s.distance AS d, s.distance / nullif(k.minimum_distance, 0) AS nd FROM steps s JOIN kept k USING (pos, track_id)),
f AS (SELECT pos, track_id, x, 'plain_regression' AS family, d AS y FROM j UNION ALL SELECT pos, track_id, x, 'normalized_regression', nd FROM j
  UNION ALL SELECT pos, track_id, x, 'logarithmic_plain_regression', CASE WHEN d > 0 THEN ln(d) ELSE CAST('-infinity' AS DOUBLE) END FROM j
  UNION ALL SELECT pos, track_id, x, 'logarithmic_normalized_regression', CASE WHEN nd > 0 THEN ln(nd) ELSE CAST('-infinity' AS DOUBLE) END FROM j),
g AS (SELECT *, CASE WHEN isfinite(y) THEN y END AS yf, coalesce(isinf(y), false) AS bad FROM f)
SELECT pos, track_id, family, CASE WHEN NOT bool_or(bad) THEN regr_count(yf, x) END AS n, {_fit('x', 'yf', guard='bool_or(bad)')} FROM g GROUP BY pos, track_id, family""")
def regress_tracks(spark, sf):
    s = _steps(spark, sf)
    return _fits(tr.track_regressions(s, tr.track_table(s)))


def _optimized_sql(series: str, keys: str) -> str:
    """SQL: rank, blocks of a tenth (three at least), span of the good blocks, fit over the span."""
    return f"""{series}, r AS (SELECT {keys}, x, y, row_number() OVER (PARTITION BY {keys} ORDER BY x, y) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT {keys}, x, CASE WHEN isfinite(y) THEN y ELSE -36.04365338911715 END AS y FROM series WHERE x IS NOT NULL AND y IS NOT NULL)),
w AS (SELECT *, greatest(3, CAST(floor(n * 0.1) AS BIGINT)) AS w FROM r),
b AS (SELECT {keys}, i // w AS k, min(i) AS lo, max(i) + 1 AS hi, CASE WHEN regr_sxx(y, x) * regr_syy(y, x) > 0 THEN regr_sxy(y, x) / sqrt(regr_sxx(y, x) * regr_syy(y, x)) END AS rv, count(*) AS c FROM w GROUP BY {keys}, i // w),
p AS (SELECT {keys}, min(CASE WHEN rv > 0.9 AND c >= 2 THEN lo END) AS begin_index, max(CASE WHEN rv > 0.9 AND c >= 2 THEN hi END) AS end_index FROM b GROUP BY {keys}),
q AS (SELECT w.*, p.begin_index, p.end_index, CASE WHEN i >= begin_index AND i < end_index THEN x END AS xf, CASE WHEN i >= begin_index AND i < end_index THEN y END AS yf FROM w JOIN p USING ({keys}))
SELECT {keys}, max(begin_index) AS begin_index, max(end_index) AS end_index, round(coalesce(max(CASE WHEN i = begin_index THEN x END), -1.0), 8) + 0.0 AS "begin", round(coalesce(max(CASE WHEN end_index IS NOT NULL AND i = least(end_index, n - 1) THEN x END), -1.0), 8) + 0.0 AS "end",
regr_count(yf, xf) AS n, {_fit('xf', 'yf')} FROM q GROUP BY {keys}"""


@query(_optimized_sql(f"WITH {STEPS}, series AS (SELECT pos, track_id, timepoint AS x, distance AS y FROM steps)", "pos, track_id"))
def regress_optimized(spark, sf):
    return _fits(tr.optimized_regression(_steps(spark, sf), ["pos", "track_id"], "timepoint", "distance", bucket=tr.STRETCH))


@query(_optimized_sql(f"WITH l AS ({_POS_LONG}), series AS (SELECT pos, field, 'linear' AS scale, x, v AS y FROM l WHERE v IS NOT NULL UNION ALL SELECT pos, field, 'logarithmic', x, {_LOG} FROM l WHERE v IS NOT NULL)", "pos, field, scale"))
def regress_position_optimized(spark, sf):
    return _fits(tr.position_regressions_optimized(table(spark, sf, "result_table")))


_LN = "CASE WHEN {d} > 0 THEN ln({d}) ELSE CAST('-infinity' AS DOUBLE) END"
_FAMILY_SERIES = (
    f"WITH {TRACKS}, j AS (SELECT s.pos, s.track_id, s.timepoint AS x, s.distance AS d, s.distance / nullif(k.minimum_distance, 0) AS nd FROM steps s JOIN kept k USING (pos, track_id)), series AS ("
    + " UNION ALL ".join(f"SELECT pos, track_id, '{f}' AS family, x, {y} AS y FROM j" for f, y in zip(tr.FAMILIES, ("d", "nd", _LN.format(d="d"), _LN.format(d="nd")))) + ")"
)


@query(_optimized_sql(_FAMILY_SERIES, "pos, track_id, family"))
def regress_tracks_optimized(spark, sf):
    s = _steps(spark, sf)
    return _fits(tr.track_regressions_optimized(s, tr.track_table(s)))


@query()
def regress_p_values(spark, sf):
    """Fits of all kept tracks with their two-sided p-values."""
    s = _steps(spark, sf)
    x = tr.track_regressions(s, tr.track_table(s))
    return x.withColumn("pvalue", p_value(F.col("rvalue"), F.col("n")))


_TRACK_COLS = ["pos", "track_id", "timepoint_begin", "timepoint_end", "timepoint_center", "minimum_distance", "maximum_distance", "minimum_distance_num", "maximum_distance_num", "duration", "count"]


@query(f"WITH {TRACKS} SELECT pos, track_id, " + ", ".join(f'round({c}, 7) + 0.0 AS {c}' for c in _TRACK_COLS[2:7]) + ", minimum_distance_num + 0.0 AS minimum_distance_num, maximum_distance_num + 0.0 AS maximum_distance_num, round(duration, 7) + 0.0 AS duration, \"count\" FROM kept")
def track_table(spark, sf):
    return rounded(tr.track_table(_steps(spark, sf)).select(*_TRACK_COLS), 7)


@query(f"""WITH {STEPS}, n AS (SELECT *, lead(timepoint) OVER w AS nt, lead(distance) OVER w AS nd FROM steps WINDOW w AS (PARTITION BY pos, track_id ORDER BY timepoint, i DESC)),
m AS (SELECT *, (nd - distance) / nullif((nt - timepoint) / 3600, 0) AS mu FROM n)
SELECT pos, track_id, i, round(timepoint, 6) + 0.0 AS timepoint, round(distance, 6) + 0.0 AS distance, round(nd, 6) + 0.0 AS next_distance, round(mu, 6) + 0.0 AS mu_per_h,
CASE WHEN nd IS NULL THEN 'last' WHEN nd < distance AND coalesce(abs(1 - distance / nullif(nd, 0)), CAST('infinity' AS DOUBLE)) > 0.2 THEN 'shortcut' WHEN NOT coalesce(mu > 0 AND mu < 100, false) THEN 'rate' ELSE 'goes on' END AS fate FROM m""")
def track_fates(spark, sf):
    return rounded(tr.step_fates(_steps(spark, sf)))


@query(f"WITH {STEPS}, p AS (SELECT a.pos, a.track_id, a.i, a.distance AS d, b.distance AS e FROM steps a JOIN steps b ON a.pos = b.pos AND a.track_id = b.track_id AND b.i = a.i + 1) SELECT pos, track_id, i, d <> 0 AND e <> 0 AND (e > d OR coalesce(abs(1 - d / nullif(e, 0)) < 0.2, false)) AS allowed FROM p")
def distance_condition(spark, sf):
    s = _steps(spark, sf).select("pos", "track_id", "i", "distance")
    later = s.select("pos", "track_id", (F.col("i") - 1).alias("i"), F.col("distance").alias("later"))
    return s.join(later, ["pos", "track_id", "i"]).select("pos", "track_id", "i", tr.shrinkage_allowed(F.col("distance"), F.col("later")).alias("allowed"))


_FR = f"f AS (SELECT pos, {_fin('timepoint')} AS timepoint, max({_fin('covered_ratio')}) AS covered_ratio, max({_fin('graph_node_count')}) AS nodes FROM result_table WHERE {_fin('timepoint')} IS NOT NULL GROUP BY pos, {_fin('timepoint')})"


def _frames(spark, sf):
    r = table(spark, sf, "result_table").select("pos", tr.finite(F.col("timepoint")).alias("timepoint"), tr.finite(F.col("covered_ratio")).alias("covered_ratio"), tr.finite(F.col("graph_node_count")).alias("nodes"))
    return r.where("timepoint is not null").groupBy("pos", "timepoint").agg(F.max("covered_ratio").alias("covered_ratio"), F.max("nodes").alias("nodes"))


@query(f"WITH {_FR}, p AS (SELECT *, lead(timepoint) OVER (PARTITION BY pos ORDER BY timepoint) AS n FROM f) SELECT pos, round(timepoint, 6) + 0.0 AS timepoint, round(n, 6) + 0.0 AS next_timepoint, round(n - timepoint, 6) + 0.0 AS seconds FROM p WHERE n IS NOT NULL")
def pairwise_frames(spark, sf):
    p = tr.pairwise(_frames(spark, sf), ["pos"], "timepoint", ["timepoint"])
    n = F.col("following.timepoint")
    return p.select("pos", (F.round("timepoint", 6) + 0.0).alias("timepoint"), (F.round(n, 6) + 0.0).alias("next_timepoint"), (F.round(n - F.col("timepoint"), 6) + 0.0).alias("seconds"))


@query(f"WITH {_FR}, s AS (SELECT pos, min(timepoint) AS stop FROM f WHERE covered_ratio > 0.2 GROUP BY pos) SELECT f.pos, round(timepoint, 6) + 0.0 AS timepoint, covered_ratio + 0.0 AS covered_ratio FROM f LEFT JOIN s ON f.pos = s.pos WHERE stop IS NULL OR timepoint < stop")
def coverage_stop(spark, sf):
    x = tr.taken_while(_frames(spark, sf), ["pos"], "timepoint", F.col("covered_ratio") > Tunables().TrackingMaximumCoverage)
    return x.select("pos", (F.round("timepoint", 6) + 0.0).alias("timepoint"), (F.col("covered_ratio") + 0.0).alias("covered_ratio"))


@query("SELECT pos, t, CAST(next_id AS INTEGER) AS next_id, max(node_id) AS node_id, count(DISTINCT node_id) AS n_candidates FROM node_links WHERE next_id >= 0 GROUP BY pos, t, next_id")
def links_reverse(spark, sf):
    return tr.reverse_links(table(spark, sf, "node_links"))


@query("""WITH n AS (SELECT DISTINCT pos, t, node_id FROM node_links), e AS (SELECT DISTINCT pos, t, node_id, unnest(alternatives) AS alt FROM node_links WHERE alternatives IS NOT NULL)
SELECT pos, t, node_id, count(*) AS n_alternatives, min(alt) AS first_alternative FROM e GROUP BY pos, t, node_id""")
def links_alternatives(spark, sf):
    e = table(spark, sf, "node_links").select("pos", "t", "node_id", F.explode("alternatives").alias("alt"))
    return e.groupBy("pos", "t", "node_id").agg(F.count_distinct("alt").alias("n_alternatives"), F.min("alt").alias("first_alternative"))


@query("""WITH f AS (SELECT pos, t, min(timepoint) AS timepoint, count(DISTINCT node_id) AS n FROM node_links GROUP BY pos, t)
SELECT pos, t, round(timepoint, 6) + 0.0 AS z, CAST(n AS BIGINT) AS n_nodes, CAST(coalesce(sum(n) OVER (PARTITION BY pos ORDER BY timepoint, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_node FROM f
QUALIFY row_number() OVER (PARTITION BY pos ORDER BY timepoint DESC, t DESC) > 1""")
def overall_graph_offsets(spark, sf):
    return gr.overall_offsets(table(spark, sf, "node_links"))


@query("""WITH f AS (SELECT pos, t, min(timepoint) AS tp, count(DISTINCT node_id) AS n FROM node_links GROUP BY pos, t),
o AS (SELECT pos, t, tp, coalesce(sum(n) OVER w, 0) AS first_node, row_number() OVER (PARTITION BY pos ORDER BY tp DESC, t DESC) AS back, lead(t) OVER (PARTITION BY pos ORDER BY tp, t) AS next_t FROM f WINDOW w AS (PARTITION BY pos ORDER BY tp, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM o WHERE back > 1), l AS (SELECT pos, t, node_id, max(next_id) AS next_id FROM node_links GROUP BY pos, t, node_id)
SELECT l.pos, CAST(a.first_node + l.node_id AS BIGINT) AS source, CAST(b.first_node + l.next_id AS BIGINT) AS target FROM l JOIN k a ON a.pos = l.pos AND a.t = l.t JOIN k b ON b.pos = a.pos AND b.t = a.next_t WHERE l.next_id >= 0""")
def overall_graph_edges(spark, sf):
    return gr.temporal_edges(table(spark, sf, "node_links"))


# --- records, names, provenance -------------------------------------------------------------------------------------
@query(r"SELECT pos, filename, regexp_replace(translate(filename, '/:\.-?=&;', '_________'), '^_', '') AS node_name, printf('pos_%09d_t_Collected', pos) AS meta_key FROM positions")
def node_names(spark, sf):
    p = table(spark, sf, "positions")
    return p.select("pos", "filename", names.node_name(F.col("filename")).alias("node_name"), names.meta_key(F.col("pos")).alias("meta_key"))


@query("SELECT doc_id, base64(unhex(sha256(text))) AS image_sha256_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", names.content_hash(F.col("text")).alias("image_sha256_hash"))


@query("SELECT pos, arg_min(calibration, row_id) AS calibration, count(DISTINCT calibration) <= 1 AS is_constant FROM result_table WHERE calibration IS NOT NULL AND NOT isnan(calibration) GROUP BY pos")
def calibration_check(spark, sf):
    return rs.copied_calibration(table(spark, sf, "result_table"))


@query("SELECT row_id, pos FROM result_table WHERE pos NOT IN (SELECT pos FROM result_table WHERE input_height < 40 OR input_width < 40)")
def skip_small_positions(spark, sf):
    r = table(spark, sf, "result_table").select("row_id", "pos", F.col("input_height").alias("height"), F.col("input_width").alias("width"))
    return fr.without_small_positions(r, 40, 40).select("row_id", "pos")


@query("SELECT row_id, meta_pos, meta_t FROM result_table WHERE (meta_t BETWEEN 0 AND 9 OR meta_t = 20 OR meta_t >= 30) AND meta_pos IN (0, 2)")
def select_ranges(spark, sf):
    r = table(spark, sf, "result_table")
    return r.where(rs.in_range(F.col("meta_t"), "0-9,20,30-") & rs.in_range(F.col("meta_pos"), "0,2")).select("row_id", "meta_pos", "meta_t")


@query("SELECT row_id, crop_t + 2 AS crop_t, crop_b - 2 AS crop_b, crop_l + 3 AS crop_l, crop_r - 3 AS crop_r, (crop_b - 2) - (crop_t + 2) AS height, (crop_r - 3) - (crop_l + 3) AS width FROM result_table")
def crop_arithmetic(spark, sf):
    return rs.crop_margins(table(spark, sf, "result_table"), crop_height=2, crop_width=3)


@query("SELECT pos, count(*) AS n_frames, count(CASE WHEN isfinite(covered_ratio) THEN 1 END) AS n_kept FROM result_table GROUP BY pos")
def failed_frames(spark, sf):
    r = table(spark, sf, "result_table")
    return r.groupBy("pos").agg(F.count(F.lit(1)).alias("n_frames"), F.count(tr.finite(F.col("covered_ratio"))).alias("n_kept"))


@query("SELECT row_id, round(covered_ratio * area, 4) + 0.0 AS covered_area, abs(covered_ratio * area - covered_area) < 0.01 * area AS consistent FROM result_table WHERE isfinite(covered_ratio) AND isfinite(covered_area)")
def covered_area(spark, sf):
    r = table(spark, sf, "result_table")
    a, c, g = tr.finite(F.col("covered_ratio")), tr.finite(F.col("covered_area")), F.col("area")
    return r.where(a.isNotNull() & c.isNotNull()).select("row_id", (F.round(a * g, 4) + 0.0).alias("covered_area"), (F.abs(a * g - c) < 0.01 * g).alias("consistent"))


@query("SELECT tunables_hash, count(*) AS n_frames, count(DISTINCT pos) AS n_positions FROM result_table GROUP BY tunables_hash")
def provenance(spark, sf):
    return table(spark, sf, "result_table").groupBy("tunables_hash").agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("pos").alias("n_positions"))


@query(f"SELECT row_id, {_fin('graph_edge_length')} AS graph_edge_length, {_fin('graph_edge_count')} AS graph_edge_count, graph_node_count, graph_junction_count, graph_endpoint_count, graph_node_count = graph_junction_count + graph_endpoint_count AS adds_up FROM result_table")
def wildcard_project(spark, sf):
    r = table(spark, sf, "result_table")
    p = rs.project(r, ["row_id", "graph_*_length", "graph_*_count"])
    return p.select(*[tr.finite(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in p.dtypes]).withColumn("adds_up", F.expr("graph_node_count = graph_junction_count + graph_endpoint_count"))


@query(f"WITH {TRACKS} SELECT pos, track_id, CAST(dense_rank() OVER (PARTITION BY pos ORDER BY track_id) - 1 AS INTEGER) AS aux_table, format('track_table_aux_tables_{{:09d}}', dense_rank() OVER (PARTITION BY pos ORDER BY track_id) - 1) AS individual_table FROM kept")
def aux_mapping(spark, sf):
    return rs.aux_mapping(tr.track_table(_steps(spark, sf)))


@query(f"WITH {TRACKS}, l AS (SELECT pos, track_id, row_number() OVER (PARTITION BY pos ORDER BY \"count\" DESC, track_id) AS r FROM kept) SELECT s.pos, s.track_id, s.i, round(s.distance - min(s.distance) OVER (PARTITION BY s.pos, s.track_id), 6) + 0.0 AS relative_distance FROM steps s JOIN l ON s.pos = l.pos AND s.track_id = l.track_id AND l.r = 1")
def longest_track(spark, sf):
    """Steps of each position's longest track, looked up by its mapping, relative to their least distance."""
    s = _steps(spark, sf)
    return rounded(rs.longest_tracks(s, tr.track_table(s)))


@query(f"WITH {STEPS} SELECT pos, track_id, i, round(avg(distance) OVER (PARTITION BY pos, track_id ORDER BY i, timepoint, distance ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS smoothed FROM steps")
def moving_average(spark, sf):
    return rounded(tr.smoothed(_steps(spark, sf)))


@query("SELECT pos FROM result_table INTERSECT SELECT pos FROM node_links")
def positions_with_links(spark, sf):
    return table(spark, sf, "result_table").select("pos").intersect(table(spark, sf, "node_links").select("pos"))


@query("SELECT pos FROM positions EXCEPT SELECT pos FROM result_table")
def positions_without_frames(spark, sf):
    return table(spark, sf, "positions").select("pos").exceptAll(table(spark, sf, "result_table").select("pos").distinct()).distinct()


@query("""SELECT filename, count(DISTINCT meta_pos) AS n_positions, count(*) AS n_frames, round(max(CASE WHEN isfinite(timepoint) THEN timepoint END), 6) + 0.0 AS last_timepoint FROM result_table GROUP BY filename""")
def result_overview(spark, sf):
    return rounded(rs.overview(table(spark, sf, "result_table")))


@query(f"WITH {TRACKS} SELECT p.filename, count(DISTINCT k.pos) AS n_positions, count(*) AS n_tracks, round(max(maximum_distance), 6) + 0.0 AS longest FROM kept k JOIN positions p ON k.pos = p.pos GROUP BY p.filename")
def tracks_by_recording(spark, sf):
    k = tr.track_table(_steps(spark, sf)).join(table(spark, sf, "positions").select("pos", "filename"), "pos")
    return rounded(k.groupBy("filename").agg(F.count_distinct("pos").alias("n_positions"), F.count(F.lit(1)).alias("n_tracks"), F.max("maximum_distance").alias("longest")))


@query("""WITH n AS (SELECT pos, t, node_id, max(next_id) AS next_id FROM node_links GROUP BY pos, t, node_id)
SELECT pos, t, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">' || string_agg('<node id="n' || node_id || '"/>', '' ORDER BY node_id)
|| coalesce(string_agg('<edge source="n' || node_id || '" target="s' || CAST(next_id AS INTEGER) || '"/>', '' ORDER BY node_id) FILTER (next_id >= 0), '') || '</graph></graphml>' AS graphml FROM n GROUP BY pos, t""")
def graphml_frames(spark, sf):
    """GraphML of every frame's correspondences: nodes, and edges to the nodes of the next frame."""
    return gr.graphml_of_links(table(spark, sf, "node_links"))


# --- rasters --------------------------------------------------------------------------------------------------------
PX = """f AS (SELECT label AS pos, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, CAST(embedding AS DOUBLE[]) AS px FROM embeddings),
p AS (SELECT pos, t, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, px[i] AS v FROM f, range(1, 65) r(i))"""
DARK = f"{PX}, m AS (SELECT pos, t, y, x, v < avg(v) OVER (PARTITION BY pos, t) AS on_ FROM p), s AS (SELECT pos, t, y, x FROM m WHERE on_)"
BOX = f"""{PX}, e AS (SELECT pos, t, CAST(yy AS INTEGER) AS yy, CAST(xx AS INTEGER) AS xx, p.v FROM range(-2, 10) a(yy), range(-2, 10) b(xx), p WHERE p.y = CASE WHEN yy < 0 THEN -yy WHEN yy > 7 THEN 14 - yy ELSE yy END AND p.x = CASE WHEN xx < 0 THEN -xx WHEN xx > 7 THEN 14 - xx ELSE xx END),
b AS (SELECT p.pos, p.t, p.y, p.x, any_value(p.v) AS v, sum(e.v) / 25.0 AS mean, sqrt(greatest(sum(e.v * e.v) / 25.0 - (sum(e.v) / 25.0) ** 2, 0)) AS std FROM p JOIN e ON p.pos = e.pos AND p.t = e.t AND e.yy BETWEEN p.y - 1 AND p.y + 2 AND e.xx BETWEEN p.x - 1 AND p.x + 2 GROUP BY p.pos, p.t, p.y, p.x)"""


def _vectors(spark, sf):
    return fr.frames_of_vectors(table(spark, sf, "embeddings"))


def _dark(spark, sf):
    f = _vectors(spark, sf)
    return f.withColumn("pixels", F.transform(fr.dark_mask(F.col("pixels")), lambda b: b.cast("double")))


@query(f"WITH {PX} SELECT pos, t, y, x, v FROM p")
def frame_explode(spark, sf):
    f = _vectors(spark, sf).select("pos", "t", F.posexplode("pixels").alias("i", "v"))
    return f.select("pos", "t", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


@query(f"WITH {PX} SELECT pos, t, 120.0 AS input_height, 120.0 AS input_width, 8 AS input_height_pixel, 8 AS input_width_pixel, 14400.0 AS area, 64 AS area_pixel FROM f")
def frame_stats(spark, sf):
    return fr.image_statistics(_vectors(spark, sf).withColumn("calibration", F.lit(15.0)))


@query(f"WITH {PX}, r AS (SELECT pos, t, y, x, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS n FROM p WINDOW w AS (PARTITION BY pos, t)) SELECT pos, t, y, x, round(n, 9) + 0.0 AS normalized, CAST(coalesce(floor(n * 255), 0) AS SMALLINT) AS uint8 FROM r")
def rescale_frames(spark, sf):
    f = _vectors(spark, sf)
    z = F.arrays_zip(fr.normalized(F.col("pixels")).alias("n"), fr.rescaled_uint8(F.col("pixels")).alias("u"))
    e = f.select("pos", "t", F.posexplode(z).alias("i", "z"))
    return e.select("pos", "t", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), (F.round("z.n", 9) + 0.0).alias("normalized"), F.col("z.u").alias("uint8"))


@query(f"WITH {PX} SELECT pos, t, y - 1 AS y, x - 2 AS x, v FROM p WHERE y >= 1 AND y < 7 AND x >= 2 AND x < 6")
def crop_frames(spark, sf):
    f = fr.cropped(_vectors(spark, sf), 1, 2)
    e = f.select("pos", "t", "width", F.posexplode("pixels").alias("i", "v"))
    return e.select("pos", "t", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "v")


@query(f"WITH {PX}, m AS (SELECT pos, t, v < avg(v) OVER (PARTITION BY pos, t) AS on_ FROM p) SELECT pos, t, count(*) FILTER (on_) / 64.0 AS covered_ratio, count(*) FILTER (on_) * 2.25 AS covered_area, CAST(count(*) FILTER (on_) AS INTEGER) AS covered_area_pixel, CAST(count(*) FILTER (NOT on_) AS INTEGER) AS inverted_pixel FROM m GROUP BY pos, t")
def quantify_binary(spark, sf):
    f = _vectors(spark, sf).withColumn("calibration", F.lit(1.5)).withColumn("mask", fr.dark_mask(F.col("pixels")))
    return fr.quantified(f).withColumn("inverted_pixel", F.lit(64) - F.col("covered_area_pixel"))


@query(f"WITH {PX}, a AS (SELECT pos, t, y, x, v FROM p), r AS (SELECT pos, y, x, v AS ref FROM p WHERE t = 1) SELECT a.pos, a.t, round(avg(a.v / nullif(r.ref, 0)), 6) + 0.0 AS mean_ratio FROM a JOIN r ON a.pos = r.pos AND a.y = r.y AND a.x = r.x GROUP BY a.pos, a.t")
def flat_field(spark, sf):
    """Frames divided by the reference frame (t = 1) of their position."""
    return rounded(rs.divided_by_reference(_vectors(spark, sf)))


@query(f"WITH {BOX} SELECT pos, t, y, x, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM b")
def box_mean_std(spark, sf):
    return rounded(fr.box_statistics(_vectors(spark, sf), 2))


_THRESHOLD_SQL = {
    "sauvola": "mean * (1 + 0.5 * (std / 128.0 - 1))",
    "wolf": "0.5 * mean + 0.5 * (min(v) OVER w) + 0.5 * (std / max(std) OVER w) * (mean - min(v) OVER w)",
    "nick": "mean - 0.1 * sqrt((sum(v * v) OVER w - mean ** 2) / 64.0)",
    "bataineh": "mean - (mean ** 2 - std) / ((avg(v) OVER w + std) * (std + (std - min(std) OVER w) / (max(std) OVER w - min(std) OVER w)))",
}


#: SQL: box statistics of frames brought to 0-1, the threshold brought back to the frame's own values
_PHANSALKAR_SQL = "WITH " + BOX.replace("p AS (SELECT pos, t,", "p0 AS (SELECT pos, t,", 1).replace("e AS (SELECT pos, t,", "p AS (SELECT pos, t, y, x, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS v, max(v) OVER w - min(v) OVER w AS wide, min(v) OVER w AS low FROM p0 WINDOW w AS (PARTITION BY pos, t)),\ne AS (SELECT pos, t,", 1) + " SELECT b.pos, b.t, b.y, b.x, round(mean * (1 + 2.0 * exp(-10.0 * mean) + 0.25 * (std / 0.5 - 1)) * wide + low, 5) + 0.0 AS threshold FROM b JOIN p USING (pos, t, y, x)"


def _threshold_query(technique):
    def run(spark, sf):
        return fr.thresholds(_vectors(spark, sf), technique, window_size=2).select("pos", "t", "y", "x", (F.round("threshold", 5) + 0.0).alias("threshold"))

    run.__name__ = f"threshold_{technique}"
    sql = _THRESHOLD_SQL.get(technique)
    if technique == "phansalkar":
        return query(_PHANSALKAR_SQL)(run)
    return query(f"WITH {BOX} SELECT pos, t, y, x, round({sql}, 5) + 0.0 AS threshold FROM b WINDOW w AS (PARTITION BY pos, t)" if sql else None)(run)


for _technique in raster.TECHNIQUES:
    _threshold_query(_technique)

_RING = "(CASE b.y - a.y WHEN -1 THEN CASE b.x - a.x WHEN 0 THEN 2 WHEN -1 THEN 1 ELSE 4 END WHEN 0 THEN CASE b.x - a.x WHEN -1 THEN 128 ELSE 8 END ELSE CASE b.x - a.x WHEN -1 THEN 64 WHEN 0 THEN 32 ELSE 16 END END)"


@query(f"""WITH {DARK}, c AS (SELECT a.pos, a.t, a.y, a.x, CAST(count(b.y) AS INTEGER) AS connectivity, CAST(coalesce(sum(CASE WHEN b.y IS NOT NULL THEN {_RING} END), 0) AS INTEGER) AS neighbourhood FROM s a LEFT JOIN s b ON a.pos = b.pos AND a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.pos, a.t, a.y, a.x)
SELECT *, CASE WHEN connectivity = 1 THEN 'end' WHEN connectivity = 2 THEN 'edge' WHEN connectivity > 2 THEN 'junction' ELSE 'single' END AS pixel_class FROM c""")
def neighbour_maps(spark, sf):
    return fr.neighbour_maps(_dark(spark, sf))


@query(f"""WITH RECURSIVE {DARK}, n AS (SELECT pos, t, y, x, y * 8 + x AS id FROM s), e AS (SELECT a.pos, a.t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.pos = b.pos AND a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
c AS (SELECT pos, t, id AS a, id AS root FROM n UNION SELECT e.pos, e.t, e.b, c.root FROM c JOIN e ON e.pos = c.pos AND e.t = c.t AND e.a = c.a),
r AS (SELECT pos, t, a, min(root) AS root FROM c GROUP BY pos, t, a)
SELECT pos, t, CAST(a // 8 AS INTEGER) AS y, CAST(a % 8 AS INTEGER) AS x, CAST(dense_rank() OVER (PARTITION BY pos, t ORDER BY root) AS INTEGER) AS label FROM r""")
def label_components(spark, sf):
    return fr.labelled(_dark(spark, sf))


@query(f"""WITH RECURSIVE {DARK}, n AS (SELECT pos, t, y, x, y * 8 + x AS id FROM s), e AS (SELECT a.pos, a.t, a.id AS a, b.id AS b FROM n a JOIN n b ON a.pos = b.pos AND a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
c AS (SELECT pos, t, id AS a, id AS root FROM n UNION SELECT e.pos, e.t, e.b, c.root FROM c JOIN e ON e.pos = c.pos AND e.t = c.t AND e.a = c.a),
r AS (SELECT pos, t, a, min(root) AS root FROM c GROUP BY pos, t, a), z AS (SELECT pos, t, root, count(*) AS size FROM r GROUP BY pos, t, root HAVING count(*) >= 6)
SELECT pos, t, CAST(sum(size) AS INTEGER) AS n_left, CAST(count(*) AS INTEGER) AS n_components FROM z GROUP BY pos, t""")
def small_structures(spark, sf):
    """What is left of each mask without components below six pixels; frames with nothing left have no row."""
    kept = fr.labelled(fr.masks(_dark(spark, sf), lambda m, cal: raster.remove_small(m, 6)))
    return kept.groupBy("pos", "t").agg(F.count(F.lit(1)).cast("int").alias("n_left"), F.count_distinct("label").cast("int").alias("n_components"))


@query()
def border_artifacts(spark, sf):
    left = fr.masks(_dark(spark, sf), lambda m, cal: raster.remove_border_artifacts(m, 2.0 / cal))
    return left.select("pos", "t", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("n_left"))


@query()
def cleaned_skeletons(spark, sf):
    """Masks smoothed, holes filled, and thinned to skeletons."""
    clean = fr.masks(_dark(spark, sf), lambda m, cal: raster.thin(raster.clean_up(m, cal, sigma_um=0.3)))
    return clean.select("pos", "t", F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v).alias("n_pixels"))


@query()
def frame_graphs(spark, sf):
    """Graph statistics of every frame's skeleton."""
    g = fr.graphs(fr.masks(_dark(spark, sf), lambda m, cal: raster.thin(m)))
    return g.drop("nodes", "edges")


@query(f"""WITH q AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS y, CAST(embedding[2] AS DOUBLE) * 10 AS x FROM embeddings)
SELECT a.label, a.vec_id, min(b.vec_id) AS representative FROM q a JOIN q b ON a.label = b.label AND (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 0.25 GROUP BY a.label, a.vec_id""")
def clean_by_radius(spark, sf):
    """The point that stands for each point: the first within the radius."""
    e = table(spark, sf, "embeddings")
    p = e.select("label", "vec_id", (F.col("embedding")[0].cast("double") * 10).alias("y"), (F.col("embedding")[1].cast("double") * 10).alias("x"))
    return gr.representatives(p, ["label"], "vec_id", 0.5)


@query(f"""WITH q AS (SELECT label AS pos, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS r, vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS y, CAST(embedding[2] AS DOUBLE) * 10 AS x FROM embeddings),
n AS (SELECT pos, r // 10 AS t, CAST(r % 10 AS INTEGER) AS node_id, y, x FROM q), d AS (SELECT a.pos, a.t, a.node_id, b.node_id AS other, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS dist FROM n a JOIN n b ON a.pos = b.pos AND b.t = a.t + 1 WHERE (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4.0)
SELECT n.pos, CAST(n.t AS INTEGER) AS t, n.node_id, CAST(coalesce(arg_min(other, (dist, other)), -1) AS INTEGER) AS next_id, CAST(count(other) AS INTEGER) AS n_alternatives FROM n LEFT JOIN d ON n.pos = d.pos AND n.t = d.t AND n.node_id = d.node_id GROUP BY n.pos, n.t, n.node_id""")
def frame_links(spark, sf):
    """Nearest node of the next frame within a radius, over a grid of cells."""
    e = table(spark, sf, "embeddings").where("embedding is not null")
    p = fr.with_rank(e.select(F.col("label").alias("pos"), "vec_id", "embedding"), ["pos"], ["vec_id"], F.floor(F.col("vec_id") / 100_000))
    n = p.select("pos", F.floor(F.col("rank") / 10).cast("int").alias("t"), (F.col("rank") % 10).cast("int").alias("node_id"), (F.col("embedding")[0].cast("double") * 10).alias("y"), (F.col("embedding")[1].cast("double") * 10).alias("x"))
    return gr.matched(n, 2.0).select("pos", "t", "node_id", "next_id", F.size("alternatives").alias("n_alternatives"))


@query()
def threshold_registry(spark, sf):
    """Foreground share by the technique and parameter text of the run's configuration."""
    t = Tunables(ThresholdingTechnique="sauvola", ThresholdingParameters="window_size:3,k:0.2")
    p = thresholding_parameters(t.ThresholdingParameters, {"window_size": 15, "k": 0.5, "r": 128.0})
    x = fr.thresholds(_vectors(spark, sf), t.ThresholdingTechnique, **p)
    return x.groupBy("pos", "t").agg(F.avg(F.col("foreground").cast("double")).alias("foreground_share"))


@query()
def tracked_steps(spark, sf):
    """Frames to tracks in one go: graphs of the vectors' frames, correspondences, and the fold over them."""
    from .pipeline import analyse

    f = _vectors(spark, sf).withColumn("timepoint", F.col("t") * 600.0).withColumn("calibration", F.lit(1.0))
    t = Tunables(ThresholdingTechnique="sauvola", ThresholdingParameters="window_size:3,k:0.1", CleanUpHoleFillSize=1.0, RemoveSmallStructuresSize=3.0, BorderArtifactRemovalBorderSize=0.0, TrackingMaximumCoverage=1.0)
    return analyse(f, t).steps


def _graphs(spark, sf):
    return fr.graphs(fr.masks(_dark(spark, sf), lambda m, cal: raster.thin(m)))


@query()
def candidate_pairs(spark, sf):
    return gr.candidate_pairs(_graphs(spark, sf))


@query()
def graph_cycles(spark, sf):
    return gr.has_cycles(_graphs(spark, sf))


@query()
def graph_components(spark, sf):
    return gr.connected_nodes(_graphs(spark, sf)).select("pos", "t", "component", F.size("node_ids").alias("n_nodes"))


@query()
def graph_paths(spark, sf):
    return fr.shortest_paths(_graphs(spark, sf))


@query()
def skeleton_pathlets(spark, sf):
    return fr.pathlets_of(fr.masks(_dark(spark, sf), lambda m, cal: raster.thin(m)))


@query()
def graphml_edges(spark, sf):
    """Edges read back from the GraphML of every frame's graph."""
    return gr.read_graphml(gr.graphml_of_graphs(_graphs(spark, sf)))


@query()
def start_frame_subtracted(spark, sf):
    x = fr.start_frame_subtracted(_vectors(spark, sf), sigma=2.0)
    return x.select("pos", "t", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))), 6).alias("sum"))


@query(f"WITH {PX} SELECT pos, t, y, x, round(max(v) OVER w + min(v) OVER w - v, 9) + 0.0 AS v FROM p WINDOW w AS (PARTITION BY pos, t)")
def inverted_frames(spark, sf):
    f = fr.inverted(_vectors(spark, sf)).select("pos", "t", F.posexplode("pixels").alias("i", "v"))
    return f.select("pos", "t", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), (F.round("v", 9) + 0.0).alias("v"))


_DIRECTIONS_SQL = ", ".join(f"({b}, {dy}, {dx})" for b, (dy, dx) in raster.DIRECTIONS.items())


@query(f"""WITH {DARK}, d(bit, dy, dx) AS (VALUES {_DIRECTIONS_SQL}), e AS (SELECT a.pos, a.t, a.y, a.x, d.bit, d.dy, d.dx FROM s a, d WHERE EXISTS (SELECT 1 FROM s b WHERE b.pos = a.pos AND b.t = a.t AND b.y = a.y + d.dy AND b.x = a.x + d.dx))
SELECT e.pos, e.t, e.y, e.x, e.bit, e.dy, e.dx, o.bit AS opposite FROM e JOIN d o ON o.dy = -e.dy AND o.dx = -e.dx""")
def neighbour_directions(spark, sf):
    n = fr.neighbour_maps(_dark(spark, sf))
    return n.select("pos", "t", "y", "x", F.explode(gr.directions(F.col("neighbourhood"))).alias("d")).select("pos", "t", "y", "x", "d.*")
