"""The flat graph against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tenderflow.llm import flat_graph
from tenderflow.llm.flat_graph import Plan

SCHEMA = "vec_id long, embedding array<float>, label int, row long, node string, grp string, block string"
SMALL = Plan(shard=40, block=60, part=50, reach=8, candidates=24, degree=12)


def usable(v, label):
    return label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute(rows, threshold=0.98):
    """Sorted (vec_id, n_links, component_id, kept) and the number of links."""
    n = len(rows)
    near = [[] for _ in rows]
    unit = [np.float32(r[1]).astype(float) / np.linalg.norm(np.float32(r[1]).astype(float)) if usable(r[1], r[2]) else None for r in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].append(j)
                near[j].append(i)
    component, out = [None] * n, []
    for i in range(n):
        if component[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                component[j] = (min(ids) if ids else None,)
    for r, x, c in zip(rows, near, component, strict=True):
        out.append((r[0], len(x), c[0], r[0] == c[0]))
    return sorted(out, key=str), sum(map(len, near))


def near_duplicates(spark, rows, **options):
    df = spark.createDataFrame([(*r, 7, "node", "grp", "block") for r in rows], SCHEMA).repartition(4)
    got = flat_graph.near_duplicates(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(seed, n, groups, dim=16):
    """Vectors of three labels, some as near copies around others, some as exact copies."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for i in range(n):
        out.append((rng.normal(size=dim), int(rng.integers(3))))
    for size, spread in groups:
        center, label = rng.normal(size=dim), int(rng.integers(3))
        center *= 4 / np.linalg.norm(center)
        out += [(center + spread * rng.normal(size=dim), label) for _ in range(size)]
    out += [out[5]] * 9 + [out[-1]] * 4
    order = rng.permutation(len(out))
    return [(int(k) * 3 - 10, [float(x) for x in out[i][0]], out[i][1]) for k, i in enumerate(order)]


GROUPS = [(30, 0.05), (12, 0.1), (2, 0.01), (2, 0.05), (60, 0.11), (3, 0.14)]


def test_all_links(spark):
    rows = vectors(1, 400, GROUPS)
    want, links = brute(rows)
    assert links > 2000
    assert near_duplicates(spark, rows) == want


def test_many_shards_blocks_and_parts(spark):
    """Overlapping shards, several blocks, blocks in parts: nothing false is found, and little is missed."""
    rows = vectors(2, 700, GROUPS)
    want, links = brute(rows)
    got = near_duplicates(spark, rows, plan=SMALL)
    by_id = {w[0]: w for w in want}
    assert all(g[1] <= by_id[g[0]][1] for g in got)
    assert sum(g[1] for g in got) >= 0.97 * links
    assert sum(g == by_id[g[0]] for g in got) >= 0.97 * len(want)


def test_hot_group_in_parts(spark):
    """A group of near copies larger than a part keeps all its links."""
    rows = vectors(3, 60, [(300, 0.04)])
    want, _ = brute(rows)
    assert near_duplicates(spark, rows, plan=SMALL) == want


def test_what_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 0), (10, [2.0, 0.0], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1),
        (None, None, None), (13, [0.0, -0.0], 1), (14, [-0.0, 5.0], 2), (15, [0.0, 5.0], 2), (16, [1e30, 1e30], 2), (17, [1e-30, 1e-30], 2),
    ]
    assert near_duplicates(spark, rows) == sorted(
        [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, 13)] + [(9, 1, 9, True), (10, 1, 9, False), (12, 2, 12, True), (12, 2, 12, True), (None, 2, 12, False),
        (None, 0, None, True), (None, 0, None, True), (14, 1, 14, True), (15, 1, 14, False), (16, 1, 16, True), (17, 1, 16, False)], key=str)
    assert near_duplicates(spark, []) == []


def test_pruned_edges_lead_on():
    """Of candidates behind each other only the first stays; nodes in other directions stay."""
    u = flat_graph.unit(np.array([[1.0, 0], [0.99, 0.05], [0.98, 0.1], [0.98, -0.1]]))
    best, score = flat_graph.nearest(u, 3)
    assert best[0].tolist() == [1, 2, 3]
    assert flat_graph.robust_prune(u, best, score, 3, 1.2)[0].tolist() == [1, 3, -1] or flat_graph.robust_prune(u, best, score, 3, 1.2)[0].tolist() == [1, -1, 3]


def test_audit_builds_again(spark, monkeypatch):
    """Where the audit finds too little, the next turn is wider; it does not go on for ever."""
    plans = []
    searched = flat_graph.searched

    def noted(nodes, clusters, plan, threshold):
        plans.append(plan)
        return searched(nodes, clusters, plan, threshold)

    monkeypatch.setattr(flat_graph, "searched", noted)
    monkeypatch.setattr(flat_graph, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        near_duplicates(spark, vectors(4, 50, [(5, 0.05)]))
    assert [p.degree for p in plans] == [24, 48, 96]


def test_audit_sees_missing_links(spark):
    rows = vectors(5, 100, [(40, 0.05)])
    df = spark.createDataFrame([(*r, 7, "", "", "") for r in rows], SCHEMA)
    nodes = flat_graph.stored(flat_graph.vector_rows(df, "vec_id", "embedding", "label").selectExpr("grp", "row AS node", "1L AS copies", "v"))
    none = nodes.selectExpr("node", "0L AS n_linked")
    assert flat_graph.audit(nodes, none, 0.98, audited=1000) == 0.0
