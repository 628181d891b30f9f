import json
from datetime import datetime

import numpy as np
import pytest

from threadmoss.operators import frametime, regular_grid, schema_drift, spikes
from threadmoss.operators.neighbours import with_previous, with_rank

ROW = "row_id bigint, pos int, meta_t int, timepoint double, covered_ratio double, covered_area double, graph_edge_length double, graph_node_count bigint, area double, calibration double, interval_s string"
PLAN = "pos int, interval_s double, calibration double"


def rows(spark, series, unit=lambda t: 1.0, pos=1, clash=True):
    """Rows from (meta_t, seconds, length, count, area covered); the clashing column must not matter."""
    out = [(i + 1, pos, m, None if s is None else s / unit(m), None if c is None else c / 1e5, c, v, n, 1e5, 0.065, "clash") for i, (m, s, v, n, c) in enumerate(series)]
    df = spark.createDataFrame(out, ROW)
    return df if clash else df.drop("interval_s")


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([(1, 600.0, 0.065), (2, 0.0, 0.065), (None, 600.0, 0.065)], PLAN)


def test_units(spark, plan):
    s = [(m, m * 600.0 + 30, 10.0 + m, 5, 9.0) for m in range(40)]
    unit = lambda m: 1.0 if m < 10 else 60.0 if m < 20 else 0.001 if m < 30 else 3600.0
    df = frametime.with_frame_seconds(rows(spark, s, unit), plan)
    got = {r["meta_t"]: r["seconds"] for r in df.collect()}
    assert all(got[m] == pytest.approx(m * 600.0 + 30, rel=1e-6) for m in range(40))
    pause = [(0, 30.0, 1.0, 1, 1.0)] + [(m, 20_000 + m * 600.0, 1.0, 1, 1.0) for m in range(1, 60)]
    got = {r["meta_t"]: r["seconds"] for r in frametime.with_frame_seconds(rows(spark, pause, clash=False), plan).collect()}
    assert got[1] == pytest.approx(20_600.0) and got[59] == pytest.approx(55_400.0)


def test_grid_against_definition(spark, plan):
    s = [(m, m * 600.0 + 10, 50 * 1.03**m, 5, 20 * 1.02**m) for m in range(300) if m not in (5, 6, 130, 131, 132)]
    s += [(7, None, 1.0, 1, 1.0), (8, 8 * 600.0, float("nan"), 1, 1.0), (9, 9 * 600.0 + 10, 50 * 1.03**9, 5, 20 * 1.02**9)]
    s = [x for x in s if not (x[0] >= 150 and x[0] < 210)]
    g = {r["slot"]: r for r in regular_grid.regular_grid(rows(spark, s), plan).collect()}
    assert set(g) == set(range(300))
    assert {k for k, r in g.items() if r["state"] != "observed"} == {5, 6, 130, 131, 132, *range(150, 210)}
    assert all(g[k]["state"] == "missing" and g[k]["graph_edge_length"] is None for k in range(150, 210))
    for k in (5, 6, 130, 131, 132):
        assert g[k]["state"] == "filled" and g[k]["graph_edge_length"] == pytest.approx(50 * 1.03**k, rel=0.02)
    assert g[9]["n_rows"] == 2


def test_grid_empty_and_unusable(spark, plan):
    assert regular_grid.regular_grid(rows(spark, [], clash=False), plan).count() == 0
    assert regular_grid.regular_grid(rows(spark, [(0, None, None, None, None)], clash=False), plan).count() == 0
    assert regular_grid.regular_grid(rows(spark, [(0, 10.0, 1.0, 1, 1.0)], pos=2, clash=False), plan).count() == 0
    one = regular_grid.regular_grid(rows(spark, [(0, 10.0, float("inf"), 1, 1.0)], clash=False), plan).collect()
    assert len(one) == 1 and one[0]["state"] == "observed"


def test_imputation_keeps_readings_and_converges():
    t = np.arange(100.0)
    x = np.vstack([np.exp(0.02 * t), 5 + np.sin(t / 5)])
    y = x.copy()
    y[:, [20, 21, 50]] = np.nan
    z = regular_grid.impute(y)
    assert np.array_equal(z[~np.isnan(y)], y[~np.isnan(y)]) and np.abs(z - x).max() < 0.2
    assert np.isnan(regular_grid.impute(np.full((1, 5), np.nan))).all()
    assert regular_grid.impute(np.array([[np.nan, 3.0, np.nan]])).tolist() == [[3.0, 3.0, 3.0]]


def test_long_gaps_stand_still():
    import pandas as pd

    t = np.arange(100.0)
    x = np.vstack([np.exp(r * t) + np.sin(t / p) for r in (0.01, 0.03, 0.05) for p in (3, 9, 20)])
    x[:, 40:62] = np.nan
    z, moving = regular_grid.imputed(x)
    again, _ = regular_grid.imputed(x, rounds=100_000)
    assert not moving.any() and np.array_equal(z, again) and np.array_equal(regular_grid.impute(x), z)
    assert regular_grid.imputed(x, rounds=2)[1][:, 40:62].any() and not regular_grid.imputed(x, rounds=2)[1][:, :40].any()
    slots = np.flatnonzero(~np.isnan(x[0]))
    block = pd.DataFrame({"pos": [1], "bucket": [0], "first_slot": [0], "last_slot": [99], "slots": [slots], "n": [np.ones(slots.size, int)], "y": [x[0][slots]]})
    state = lambda rounds: set(pd.concat(regular_grid._solver(("y",), 24, rounds)(iter([block])))["state"])
    assert state(2) >= {"observed", "unsettled"} and state(regular_grid.ROUNDS) == {"observed", "filled"}


def test_implausible(spark, plan):
    s = []
    for m in range(60):
        v, c, n = 100 * 1.02**m, 200 * 1.01**m, 30 + m
        v = 400.0 if m in (10, 11) else 0.0 if m == 20 else -5.0 if m == 30 else float("inf") if m == 33 else v
        c = 111.0 if 40 <= m < 47 else 2e5 if m == 15 else c
        n = 2147483647 if m == 50 else n
        s.append((m, m * 600.0, v, n, c))
    s = [(m, t + (9000 if m > 25 else 0), v * (1.0 if m <= 25 or not np.isfinite(v) else 1.6), n, c) for m, t, v, n, c in s]  # growth over a pause
    s += [s[10], (61, 61 * 600.0 + 9000, None, None, float("nan"))]
    df = rows(spark, s)
    found = spikes.implausible_readings(df, plan).collect()
    by = {}
    for r in found:
        by.setdefault((r["field"], r["reason"]), set()).add(r["row_id"])
    assert by[("graph_edge_length", "spike")] == {11, 12, 21, 61} and by[("graph_edge_length", "impossible")] == {31, 34}
    assert by[("covered_area", "stuck")] == set(range(42, 48)) and by[("covered_area", "impossible")] == {16}
    assert by[("graph_node_count", "impossible")] == {51} and ("graph_node_count", "spike") not in by
    assert spikes.implausible_readings(rows(spark, [], clash=False), plan).count() == 0


def test_transform_adds_up_and_keeps_steps():
    rng = np.random.default_rng(4)
    t = np.tile(np.arange(60.0), (3, 1))
    y = np.stack([np.cumsum(rng.random(60)), np.where(np.arange(60) < 30, 1.0, 4.0), np.full(60, 2.0)])
    found, rest = spikes.transform(t, y)
    assert found.shape == (spikes.WIDEST, 3, 60) and not found[:, 1].any() and not found[:, 2].any()
    y[2, 10], y[2, 20:22], y[2, 40:43] = 5.0, 0.5, 3.0
    found, rest = spikes.transform(t, y)
    assert np.allclose(rest[2], 2.0) and found[0, 2, 10] == 3.0 and (found[:2, 2, 20:22].max(0) == 1.5).all() and (found[:, 2, 40:43].max(0) == 1.0).all()


def test_sources_are_judged_by_their_own_behaviour(spark, plan):
    """The same excursion is a spike on a quiet source and noise on a restless one, however many blocks the source has."""
    rng = np.random.default_rng(6)
    quiet = [(m, m * 600.0, 100 * 1.001**m, 50, 100 * 1.001**m) for m in range(1200)]
    restless = [(m, m * 600.0, float(100 * np.exp(rng.normal(0, 0.2))), 50, float(100 * np.exp(rng.normal(0, 0.2)))) for m in range(1200)]
    for s in (quiet, restless):
        s[900] = (900, 900 * 600.0, s[899][2] * 1.3, 50, s[899][4])
    spikes_of = lambda s: {r["row_id"] for r in spikes.implausible_readings(rows(spark, s, clash=False), plan).where("reason = 'spike' and field = 'graph_edge_length'").collect()}
    assert spikes_of(quiet) == {901} and len(spikes_of(restless)) < 6 and 901 not in spikes_of(restless)


def test_first_reading_that_is_there_counts(spark, plan):
    s = [(m, m * 600.0, 100 * 1.02**m, 30, 50.0 + m) for m in range(40)]
    s.insert(20, (20, 20 * 600.0, None, 30, 70.0))  # an earlier copy without the reading
    s[21] = (20, 20 * 600.0, 900.0, 30, 70.0)
    found = spikes.implausible_readings(rows(spark, s, clash=False), plan).where("reason = 'spike'").collect()
    assert [(r["row_id"], r["field"]) for r in found] == [(22, "graph_edge_length")]


def test_zeros_before_growth_and_steps_are_fine(spark, plan):
    s = [(m, m * 600.0, 0.0 if m < 20 else 80.0 + m if m < 40 else 400.0 + m, 0 if m < 20 else 9, 0.0 if m < 20 else 50.0 + m) for m in range(60)]
    s = [(m, t, v, n + (m % 3 if n else 0), c) for m, t, v, n, c in s]
    assert spikes.implausible_readings(rows(spark, s, clash=False), plan).count() == 0


def _raw(spark, files):
    out, n = [], 0
    for no, (station, day, payloads) in enumerate(files, 1):
        for k, p in enumerate(payloads):
            n += 1
            out.append((n, no, station, datetime(2031, 3, day), datetime(2031, 3, day), k, p if p is None or isinstance(p, str) else json.dumps(p), "x"))
    return spark.createDataFrame(out, "record_id bigint, file_no int, station string, written_at timestamp, arrived_at timestamp, line_no int, payload string, field string")


def test_drift(spark):
    cat = spark.createDataFrame([("shift_x", "double", ""), ("crop_t", "int", ""), ("image", "int", ""), ("filename", "string", "")], "field string, data_type string, meaning string")
    raw = _raw(spark, [
        ("a", 1, [{"shift_x": 1, "filename": "f"}, {"shift_x": None, "filename": "f"}]),
        ("a", 3, [{"dx": "2,5 px", "crop_t": None, "filename": "f"}, "{broken", None, "[1]"]),
        ("a", 2, [{"shift_x": 1.5, "filename": "f", "gain": 2}]),
        ("b", 1, [{"img": {"id": 7, "h": 3}, "filename": "g"}]),
        ("b", 2, [None]),
        ("b", 3, [{"image": True, "filename": "g"}, {"image": True, "filename": "g"}]),
    ])
    got = {(r["file_no"], r["field"], r["change"]) for r in schema_drift.schema_changes(raw, cat).collect()}
    assert got == {(3, "shift_x", "retyped"), (3, "gain", "added"), (2, "gain", "removed"), (2, "shift_x", "renamed"), (2, "shift_x", "retyped"), (2, "crop_t", "added"), (5, "image", "removed"), (5, "filename", "removed"), (6, "image", "added"), (6, "filename", "added")}
    u = {r["record_id"]: r for r in schema_drift.unified_table(raw, cat).collect()}
    assert u[1]["shift_x"] == 1.0 and u[1]["shift_x_kind"] == "whole" and u[3]["shift_x"] == 2.5 and u[3]["shift_x_kind"] == "text"
    assert u[8]["image"] == 7 and [k for k, r in u.items() if r["image_kind"] == "truth" and r["image"] is None] and len(u) == 7
    assert schema_drift.schema_changes(raw.where("false"), cat).count() == 0


def test_branches_and_nested_paths(spark):
    cat = spark.createDataFrame([("image", "int", ""), ("gain", "double", "")], "field string, data_type string, meaning string")
    raw = _raw(spark, [
        ("a", 2, [{"image": {"id": 7, "at": [1, "x", None]}, "gain": True}, {"image": 3, "gain": [1.5, {"u": "V"}]}]),
        ("a", 1, [{"picture": {"id": "7"}, "gain": None}, "{broken", None]),
    ])
    names = {"image": ("picture",)}
    got = {(r["path"], r["kind"]): (r["n_values"], r["n_files"], r["first_file_no"]) for r in schema_drift.path_alternatives(raw, cat, names).collect()}
    assert got == {
        ("image", "object"): (2, 2, 2), ("image", "whole"): (1, 1, 1), ("image.id", "whole"): (1, 1, 1), ("image.id", "text"): (1, 1, 2), ("image.at", "list"): (1, 1, 1), ("image.at[]", "whole"): (1, 1, 1), ("image.at[]", "text"): (1, 1, 1),
        ("gain", "truth"): (1, 1, 1), ("gain", "list"): (1, 1, 1), ("gain[]", "fraction"): (1, 1, 1), ("gain[]", "object"): (1, 1, 1), ("gain[].u", "text"): (1, 1, 1),
    }
    u = {r["record_id"]: r for r in schema_drift.unified_table(raw, cat, names).collect()}
    assert u[1]["gain_branch"]["truth"] is True and u[1]["gain"] is None and u[1]["image"] == 7 and json.loads(u[1]["image_branch"]["json"])["id"] == 7
    assert u[2]["image_branch"]["whole"] == 3 and u[2]["image_branch"]["json"] is None and u[3]["gain_branch"] is None and u[3]["image"] == 7
    assert schema_drift.path_alternatives(raw.where("false"), cat).count() == 0
    assert {r["path"] for r in schema_drift.path_alternatives(raw, cat, {}).collect()} >= {"picture", "picture.id"}


def test_unified_keeps_further_fields(spark, tmp_path):
    from threadmoss.plans.problem_queries import p3_unified

    spark.createDataFrame([("shift_x", "double", "")], "field string, data_type string, meaning string").write.parquet(f"{tmp_path}/field_catalogue.parquet")
    _raw(spark, [("a", 1, [{"shift_x": 1, "ma\"in": {"b": 2}, "gain": None}, {"shift_x": 1, "dx": 2.5}, {"dx": 3}])]).write.parquet(f"{tmp_path}/raw_results.parquet")
    got = {r["record_id"]: (r["shift_x"], r["other"]) for r in p3_unified(spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, '{"gain":null,"ma\\"in":{"b":2}}'), 2: (2.5, '{"dx":2.5,"shift_x":1}'), 3: (3.0, "{}")}


def test_neighbours_across_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, float(x)) for k in (1, 2) for x in (0, 1, 5, 17, 18, 40)], "k int, x double")
    got = with_previous(df, ["k"], ["x"], F.floor(F.col("x") / 4), ["x"]).collect()
    for r in got:
        before = [y for y in (0, 1, 5, 17, 18, 40) if y < r["x"]]
        assert (r["previous"]["x"] if r["previous"] else None) == (before[-1] if before else None)
    ranks = {(r["k"], r["x"]): (r["rank"], r["group_n"]) for r in with_rank(df, ["k"], ["x"], F.floor(F.col("x") / 4)).collect()}
    assert ranks[(2, 17.0)] == (3, 6) and ranks[(1, 0.0)] == (0, 6)
