import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmoss.functions.regression import linregress, optimized_regression
from threadmoss.operators import tracks

#: fixed values: a printed track (seconds, micrometres)
TRACK = [(42345.743439, 5.898107), (42943.263915, 7.083879), (43545.771926, 7.251955), (44144.751331, 8.919651), (44744.694663, 9.688499), (45344.289949, 11.311585), (45939.743908, 12.540052), (46545.171155, 14.456596), (47147.290182, 16.146596), (47744.704740, 18.101215), (48338.214147, 20.143139), (48945.238245, 22.355845), (49539.787734, 25.077399), (50142.246928, 27.538952), (50745.344198, 31.024734), (51344.796590, 33.735136), (51944.723954, 37.211679), (52542.958177, 40.819015), (53141.803414, 45.219417), (53741.353184, 49.032112), (54341.241176, 53.111341), (54942.331510, 57.906361)]


@pytest.fixture(scope="module")
def steps(spark):
    rows = [(1, 0, i, t, 1, 2, 1, 2, d, 1.0) for i, (t, d) in enumerate(TRACK)] + [(1, 1, i, float(i), 1, 2, 1, 2, 3.0, 1.0) for i in range(4)]
    return spark.createDataFrame(rows, "pos int, track_id int, i int, timepoint double, node_id_a int, node_id_b int, node_next_id_a int, node_next_id_b int, distance double, distance_num double")


def test_golden_track(steps):
    kept = tracks.track_table(steps)
    row = kept.collect()
    assert len(row) == 1 and row[0]["count"] == 22 and row[0]["duration"] == pytest.approx(12596.588071) and row[0]["timepoint_center"] == pytest.approx(48644.037475)
    fits = {r["family"]: r for r in tracks.track_regressions(steps, kept).collect()}
    for family, slope, intercept, r, err in (("plain_regression", 0.004046, -171.583111, 0.975429, 0.000204), ("normalized_regression", 0.000686, -29.091215, 0.975429, 0.000035), ("logarithmic_plain_regression", 0.000182, -5.825405, 0.997499, 0.000003), ("logarithmic_normalized_regression", 0.000182, -7.600037, 0.997499, 0.000003)):
        f = fits[family]
        assert f["slope"] == pytest.approx(slope, abs=1e-6) and f["intercept"] == pytest.approx(intercept, abs=1e-4) and f["rvalue"] == pytest.approx(r, abs=1e-6) and f["stderr"] == pytest.approx(err, abs=1e-6)
    best = {r["family"]: r for r in tracks.track_regressions_optimized(steps, kept).collect()}
    o = best["plain_regression"]
    assert (o["begin_index"], o["end_index"]) == (0, 21) and o["slope"] == pytest.approx(0.003874, abs=1e-6) and o["rvalue"] == pytest.approx(0.976412, abs=1e-6)
    assert o["begin"] == pytest.approx(42345.743439) and o["end"] == pytest.approx(54942.331510)


def test_linear_window(spark):
    x = np.linspace(1, 100, 100)
    y = x * 5 + 10
    y[:10] = 0
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    r = optimized_regression(df, ["k"], "x", "y", bucket=7.0).first()
    assert (r["begin_index"], r["end_index"], r["begin"], r["end"]) == (10, 100, 11.0, 100.0)
    assert r["slope"] == pytest.approx(5.0) and r["intercept"] == pytest.approx(10.0)


def test_degenerate_fits(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 3.0), ("flat", 2.0, 3.0), ("flat", 3.0, 3.0), ("same_x", 1.0, 1.0), ("same_x", 1.0, 2.0), ("null", None, 1.0), ("two", 0.0, 0.0), ("two", 1.0, 2.0)], "k string, x double, y double")
    r = {x["k"]: x for x in df.groupBy("k").agg(*[c.alias(n) for n, c in linregress(F.col("x"), F.col("y")).items()]).collect()}
    assert r["one"]["slope"] is None and r["same_x"]["slope"] is None and r["null"]["n"] == 0
    assert r["flat"]["slope"] == 0 and r["flat"]["rvalue"] is None and r["two"]["slope"] == 2.0 and r["two"]["stderr"] == 0.0
    o = {x["k"]: x for x in optimized_regression(df, ["k"], "x", "y").collect()}
    assert o["flat"]["begin_index"] is None and o["flat"]["begin"] == -1.0 and o["flat"]["end"] == -1.0


def test_fates(spark):
    s = "pos int, track_id int, i int, timepoint double, distance double"
    df = spark.createDataFrame([(1, 0, 0, 0.0, 10.0), (1, 0, 1, 3600.0, 20.0), (1, 0, 2, 7200.0, 5.0), (1, 0, 3, 10800.0, 500.0), (1, 0, 4, 10800.0, 500.0)], s)
    fate = {r["i"]: r["fate"] for r in tracks.step_fates(df).collect()}
    assert fate[0] == "goes on" and fate[1] == "shortcut" and fate[2] == "rate" and "last" in (fate[3], fate[4])
