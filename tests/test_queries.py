import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if v is not None and type(v).__name__ == "Decimal":
        return repr(float(v) + 0.0)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    got = df.collect()
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert a == b


#: queries without SQL: number of rows, and the rows at a third and at two thirds of the sorted result (columns by name)
ROWS = {
    "border_artifacts": (500, (27.0, 7, 11), (31.0, 7, 6)),
    "candidate_pairs": (2120, (1, 2, 9, 18), (3, 11, 9, 2)),
    "cleaned_skeletons": (500, (22.0, 9, 52), (25.0, 9, 31)),
    "frame_graphs": (500, (19.5, 28.67767, 2, 12, 14, 2, 36), (28.0, 42.041631, 5, 14, 19, 9, 4)),
    "graph_components": (847, (0, 2, 3, 27), (1, 2, 6, 21)),
    "graph_cycles": (500, (True, 1, 5, 36), (True, 2, 4, 25)),
    "graph_paths": (115594, (14, 17, 1.414214, 1, 7, 48), (31, 19, 4.828427, 4, 9, 51)),
    "graphml_edges": (11129, (3, 'n11', 38, 'n12'), (6, 'n9', 12, 'n12')),
    "regress_p_values": (28, ('logarithmic_plain_regression', -9.16089, 0.443163, 8, 13, 0.0, 0.995325, 0.000185, 7e-06, 3), ('normalized_regression', -6.327535, 0.064237, 10, 13, 0.0, 0.999748, 0.000282, 2e-06, 1)),
    "skeleton_pathlets": (15313, (1.0, 2, 40, 0, 53), (1.414214, 2, 28, 4, 20)),
    "start_frame_subtracted": (500, (3, 23.139526, 17), (6, 52.018191, 35)),
    "threshold_experimental_thresholding": (32000, (3, 17, 0.00682, 6, 1), (6, 4, -0.0032, 3, 5)),
    "threshold_feng": (32000, (3, 17, None, 5, 2), (6, 4, None, 2, 5)),
    "threshold_registry": (500, (0.484375, 5, 29), (0.53125, 1, 10)),
    "tracked_steps": (112, (2.414214, 1.0, 12, 2, 3, 2, 0, 1, 7200.0, 2), (2.828427, 1.0, 18, 1, 0, 2, 3, 5, 10800.0, 5)),
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("p")))
def test_other_queries_keep_their_rows(name, spark, data):
    df = QUERIES[name](spark, data)
    rows = sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    n, third, two_thirds = ROWS[name]
    assert len(rows) == n and rows[n // 3] == third and rows[2 * n // 3] == two_thirds


@pytest.mark.parametrize("name", ["p2_found", "p2_grid", "p3_found", "p3_report", "p3_unified", "p3_paths", "p5_found", "p5_report"])
def test_problem_queries_run(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
