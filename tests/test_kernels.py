import numpy as np
import pytest

from threadmoss.config import Tunables, thresholding_parameters
from threadmoss.functions.regression import two_sided_p
from threadmoss.kernels import graph, raster

MIDDLE = np.array([[0, 0, 0], [1, 1, 1], [0, 0, 0]], bool)
CORNER = np.array([[0, 0, 0], [0, 0, 1], [0, 0, 1]], bool)


def test_thin_two_wide_bar():
    m = np.zeros((4, 4), bool)
    m[:, 2:] = True
    assert np.argwhere(raster.thin(m)).tolist() == [[1, 2], [2, 2]]


def test_graph_of_a_line():
    g = graph.node_graph(MIDDLE, 15.0)
    s = g.statistics(15.0)
    assert (s["graph_edge_count"], s["graph_edge_length"], s["graph_endpoint_count"], s["graph_junction_count"], s["graph_node_count"]) == (1.0, 30.0, 2, 0, 2)


def test_masks():
    ring = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert raster.clean_up(ring, 0.1).all()
    assert not raster.remove_small(CORNER, int(10 / 0.1**2)).any()
    assert not raster.remove_border_artifacts(CORNER, 10 / 0.1).any()


def test_lengths_and_merging():
    assert graph.path_length([[1, 1], [5, 5]]) == pytest.approx(5.656854249492381)
    assert graph.merged([[1, 1], [1.1, 1.1], [9, 9]], 1.5).tolist() == [[1, 1], [9, 9]]
    assert graph.merged([], 1.0).shape == (0, 2)


def test_line_is_walked_again_from_its_other_end():
    m = np.zeros((3, 12), bool)
    m[1, 1:11] = True
    assert sorted(len(p) for p in graph.pathlets(m)) == [2, 10]


def test_double_y_has_five_paths_and_one_walked_again():
    m = np.zeros((7, 14), bool)
    m[3, 3:11] = True  # a bar with two arms at either end
    for y, x in ((2, 2), (1, 1), (4, 2), (5, 1), (2, 11), (1, 12), (4, 11), (5, 12)):
        m[y, x] = True
    lines = graph.pathlets(m)
    ends = {frozenset((tuple(p[0]), tuple(p[-1]))) for p in lines}
    assert sorted(len(p) for p in lines) == [2, 3, 3, 3, 3, 8]
    assert {frozenset(((3, 3), (y, 1))) for y in (1, 5)} | {frozenset(((3, 10), (y, 12))) for y in (1, 5)} | {frozenset(((3, 3), (3, 10)))} < ends
    steps = [np.abs(np.diff(p, axis=0)).max() for p in lines]
    assert all(s == 1 for s in steps) and all(m[tuple(q)] for p in lines for q in p)


def test_components_keep_to_themselves():
    m = np.zeros((5, 9), bool)
    m[1, 0:4] = m[3, 4:9] = True
    assert sorted((len(p), int(p[0][0])) for p in graph.pathlets(m)) == [(2, 1), (2, 3), (4, 1), (5, 3)]


def test_ring_and_empty_have_no_paths():
    ring = np.zeros((6, 6), bool)
    ring[1, 2:4] = ring[4, 2:4] = ring[2:4, 1] = ring[2:4, 4] = True
    assert graph.pathlets(ring) == [] and graph.pathlets(np.zeros((4, 4), bool)) == []
    assert graph.node_graph(np.zeros((4, 4), bool), 1.0).statistics(1.0)["graph_node_count"] == 0


def test_labels_against_flood_fill():
    rng = np.random.default_rng(3)
    for _ in range(20):
        m = rng.random((9, 11)) < 0.45
        lab, n = raster.label(m)
        seen, k = np.zeros(m.shape, int), 0
        for y, x in np.argwhere(m):
            if seen[y, x]:
                continue
            k += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 9 and 0 <= b < 11 and m[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert n == k and (lab == seen).all()


def test_box_sums_against_loops():
    x = np.random.default_rng(1).random((7, 9))
    mean, std = raster.box_mean_std(x, 2)
    p = np.pad(x, 2, "reflect")
    for i, j in np.ndindex(7, 9):
        w = p[i + 1 : i + 5, j + 1 : j + 5]
        assert mean[i, j] == pytest.approx(w.sum() / 25)
        assert std[i, j] == pytest.approx(np.sqrt((w**2).sum() / 25 - (w.sum() / 25) ** 2))


@pytest.mark.parametrize("technique", raster.TECHNIQUES)
def test_every_technique_runs_and_constant_images_have_no_foreground_error(technique):
    x = np.random.default_rng(2).random((12, 14)) * 200
    assert raster.threshold(x, technique, window_size=3, window_size2=4).shape == x.shape
    assert raster.binarize(np.ones((6, 6)), technique, window_size=2, window_size2=2).dtype == bool


def test_tunables_and_parameters():
    t = Tunables().with_values(CropWidth="3", BoxDetection="true", NodeLookupRadius="0.7")
    assert (t.CropWidth, t.BoxDetection, t.NodeLookupRadius) == (3, True, 0.7) and t.hash() != Tunables().hash()
    assert thresholding_parameters("k:0.2", {"k": 0.5}) == {"k": 0.2}
    with pytest.raises(RuntimeError):
        thresholding_parameters("z:1", {"k": 0.5})
    with pytest.raises(KeyError):
        Tunables().with_values(Nothing=1)


def test_shortest_paths_and_components():
    g = graph.NodeGraph(np.zeros((4, 2)), 2, {0: {1: 2.0, 2: 9.0}, 1: {0: 2.0, 2: 3.0}, 2: {1: 3.0, 0: 9.0}})
    assert g.shortest()[0, 2] == 5.0 and g.shortest(False)[0, 2] == 1.0 and np.isinf(g.shortest()[0, 3])
    assert g.components() == [0, 0, 0, 3]


def test_p_values():
    assert two_sided_p(np.array([0.975429, 0.997499, 0.976412, np.nan, 1.0]), np.array([22, 22, 21, 5, 10]))[0] == pytest.approx(1.307881e-14, rel=2e-3)
    assert two_sided_p(np.array([1.0]), np.array([10]))[0] == 0.0 and two_sided_p(np.array([0.0]), np.array([10]))[0] == pytest.approx(1.0)
