"""From a skeleton to a weighted graph of endpoints and junctions, per frame."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .raster import DIRECTIONS, neighbours


def path_length(points: np.ndarray, window: int = 5) -> float:
    """Length of a polyline, smoothed by a moving average (whole pixels, ends repeated) if it is longer than the window."""
    p = np.asarray(points)
    if len(p) - 2 > window:
        half = window // 2
        wide = np.pad(p, [(half, half), (0, 0)], "edge").astype(float)
        c = np.concatenate([np.zeros((1, 2)), wide.cumsum(0)])
        mean = (c[window:] - c[:-window]) / window
        p = np.trunc(mean).astype(p.dtype) if np.issubdtype(p.dtype, np.integer) else mean
    d = np.diff(p.astype(float), axis=0)
    return float(np.hypot(d[:, 0], d[:, 1]).sum())


def merged(points: np.ndarray, radius: float) -> np.ndarray:
    """Points that stand for those within the radius: each keeps the first point near it, distinct ones remain."""
    p = np.asarray(points, dtype=float).reshape(-1, 2)
    if not len(p):
        return p
    first = [int(np.flatnonzero(((p - q) ** 2).sum(1) <= radius * radius)[0]) for q in p]
    return p[np.unique(first)]


def pathlets(skeleton: np.ndarray) -> list[np.ndarray]:
    """The polylines of a skeleton: chains of edge pixels between pixels with one or more than two neighbours.

    A chain has one way in from either side, so it is followed in one go: behind an edge pixel lies the neighbour that one
    didn't come from.  Pixels at the ends of chains keep account of the directions not yet used, as the sum of their
    numbers: leaving takes a direction off, arriving the one pointing back, unless nothing would be left.  Endpoints start,
    the last one first; what a reached junction has left follows in order of discovery.  So a chain's far end is visited
    again where its account wasn't closed, which gives a stub of two pixels.  Rings without an endpoint and single pixels
    give none.
    """
    h, w = skeleton.shape
    degree, bits = (np.pad(a, 1).ravel() for a in neighbours(skeleton))
    step = {b: dy * (w + 2) + dx for b, (dy, dx) in DIRECTIONS.items()}
    number = {v: b for b, v in step.items()}
    at = np.arange(degree.size)
    both = sum(np.where(bits & b, at + v, 0) for b, v in step.items())  # sum of the places of all neighbours
    inside = np.pad(np.ones((h, w), bool), 1).ravel()
    account, used = bits.copy(), np.zeros(degree.size, bool)
    visits = [(p, int(bits[p])) for p in np.flatnonzero(degree == 1)[::-1].tolist()]
    lines = []
    for start, bit in visits:  # grows by the exits of reached junctions
        if account[start] < bit:
            continue
        account[start] -= bit
        line = [start, start + step[bit]]
        if not inside[line[1]]:
            line.pop()
        elif not used[line[1]]:
            while degree[line[-1]] == 2:
                line.append(int(both[line[-1]]) - line[-2])
            used[line[1:-1]] = True
            back = number[line[-2] - line[-1]]
            if back < account[line[-1]]:
                account[line[-1]] -= back
        if degree[line[-1]] > 2:
            visits += [(line[-1], b) for b in DIRECTIONS if account[line[-1]] & b]
        lines.append(np.stack(np.divmod(line, w + 2), axis=1) - 1)
    return lines


@dataclass
class NodeGraph:
    """points (y, x), endpoints first; weight: symmetric dict of dicts; loops keep their node's own key."""

    points: np.ndarray
    n_endpoints: int
    weight: dict[int, dict[int, float]] = field(default_factory=dict)

    @property
    def edges(self) -> list[tuple[int, int, float]]:
        return sorted((a, b, v) for a, row in self.weight.items() for b, v in row.items() if a <= b)

    def statistics(self, calibration: float) -> dict:
        """Edge length and count as half the sums over the symmetric matrix: a loop counts half."""
        cells = [v for row in self.weight.values() for v in row.values()]
        n = len(self.points)
        return {"graph_edge_length": sum(cells) / 2 * calibration, "graph_edge_count": len(cells) / 2, "graph_node_count": n, "graph_endpoint_count": self.n_endpoints, "graph_junction_count": n - self.n_endpoints}

    def components(self) -> list[int]:
        comp = [-1] * len(self.points)
        for s in range(len(comp)):
            if comp[s] < 0:
                todo, comp[s] = [s], s
                while todo:
                    for b in self.weight.get(todo.pop(), ()):
                        if comp[b] < 0:
                            comp[b] = s
                            todo.append(b)
        return comp

    def shortest(self, weighted: bool = True) -> np.ndarray:
        """All-pairs shortest paths by relaxation over nodes; infinity where there is no path."""
        n = len(self.points)
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0.0)
        for a, row in self.weight.items():
            for b, v in row.items():
                if a != b:
                    d[a, b] = v if weighted else 1.0
        for k in range(n):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
        return d


def node_graph(skeleton: np.ndarray, calibration: float, endpoint_radius: float = 0.5, junction_radius: float = 0.5, lookup_radius: float = 0.5, cutoff_radius: float = 2.5) -> NodeGraph:
    """Endpoints and junctions merged by radius, each pathlet an edge between the nodes nearest to its ends.

    An end near an endpoint belongs to it; otherwise the pixel's own kind decides.  Ends beyond the cutoff make no edge; of
    parallel edges the last one stays.  Nodes without an edge are dropped.
    """
    degree, _ = neighbours(skeleton)
    ends = merged(np.argwhere(degree == 1), endpoint_radius / calibration)
    junctions = merged(np.argwhere(degree > 2), junction_radius / calibration)
    points, n_ends = np.concatenate([ends, junctions]), len(ends)

    def nearest(where: np.ndarray, q: np.ndarray) -> tuple[float, int]:
        if not len(where):
            return np.inf, -1
        d = np.hypot(*(where - q).T)
        k = int(d.argmin())
        return float(d[k]), k

    weight: dict[int, dict[int, float]] = {}
    for line in pathlets(skeleton):
        nodes = []
        for q in (line[0], line[-1]):
            near, k = nearest(ends, q)
            if not (near < lookup_radius / calibration or degree[tuple(q)] == 1):
                near, k = nearest(junctions, q)
                k += n_ends if k >= 0 else 0
            nodes.append((near, k))
        (da, a), (db, b) = nodes
        if a < 0 or b < 0 or max(da, db) > cutoff_radius / calibration:
            continue
        weight.setdefault(a, {})[b] = weight.setdefault(b, {})[a] = path_length(line)
    kept = sorted(weight)
    new = {old: i for i, old in enumerate(kept)}
    return NodeGraph(points[kept].reshape(-1, 2), sum(k < n_ends for k in kept), {new[a]: {new[b]: v for b, v in row.items()} for a, row in weight.items()})


def shortest_path(g: NodeGraph, start: int, goal: int) -> list[int]:
    """Nodes of a shortest weighted path, both ends included; empty where there is none.  Ties go to the smaller node."""
    far = g.shortest()
    if not np.isfinite(far[start, goal]):
        return []
    path = [start]
    while path[-1] != goal:
        a = path[-1]
        steps = [(v + far[b, goal], b) for b, v in g.weight.get(a, {}).items() if b != a and b not in path]
        path.append(min(steps)[1])
    return path
