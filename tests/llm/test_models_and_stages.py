"""The additive model's trees and scores against plain loops, and the pipeline's stages in odd cases."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest

from quantloom.llm.quality_model import AdditiveModel, cross_tree, shallow_tree

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def gain(g: list[float], w: list[float]) -> float:
    return sum(g) ** 2 / (sum(w) + 1)


def leaf(g: list[float], w: list[float]) -> float:
    return sum(g) / (sum(w) + 1)


def tree_by_loops(g, w, n, depth, least):
    """Leaf values bin by bin: each run of bins is cut where the two sides' gains are largest, the first of equals."""
    best, at = gain(g, w) + 1e-9, None
    if depth:
        for k in range(1, len(g)):
            if sum(n[:k]) >= least and sum(n[k:]) >= least:
                total = gain(g[:k], w[:k]) + gain(g[k:], w[k:])
                if total > best + 1e-12:
                    best, at = total, k
    if at is None:
        return [leaf(g, w)] * len(g)
    return tree_by_loops(g[:at], w[:at], n[:at], depth - 1, least) + tree_by_loops(g[at:], w[at:], n[at:], depth - 1, least)


def test_shallow_trees_are_those_of_plain_loops():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 17):
        for depth in (0, 1, 2, 3):
            g, w, n = rng.normal(size=size), rng.uniform(0.1, 2, size), rng.integers(0, 6, size)
            assert shallow_tree(g, w, n, depth, 4) == pytest.approx(tree_by_loops(list(g), list(w), list(n), depth, 4))


def cross_by_loops(g, w, n, least):
    """The best gain of one cut on an axis and one on the other in each half, over both orders of the axes."""
    best = 0.0
    for a, b, c in ((g, w, n), (g.T, w.T, n.T)):
        rows, columns = a.shape
        whole = a.sum() ** 2 / (b.sum() + 1)
        for k in range(1, rows):
            total = 0.0
            for part in (slice(0, k), slice(k, rows)):
                cuts = [
                    gain(a[part, :m].ravel(), b[part, :m].ravel()) + gain(a[part, m:].ravel(), b[part, m:].ravel())
                    for m in range(1, columns)
                    if c[part, :m].sum() >= least and c[part, m:].sum() >= least
                ]
                total = total + max(cuts) if cuts else -math.inf
            best = max(best, total - whole)
    return best


def test_cross_trees_have_the_gain_of_plain_loops():
    rng = np.random.default_rng(2)
    for shape in ((1, 4), (2, 2), (3, 5), (6, 4)):
        for _ in range(5):
            g, w, n = rng.normal(size=shape), rng.uniform(0.1, 2, shape), rng.integers(0, 4, shape)
            table, found = cross_tree(g, w, n, 2)
            assert found == pytest.approx(cross_by_loops(g, w, n, 2))
            if found > 0:  # what the leaves' values gain is what was promised
                leaves = {v: (g[table == v].sum(), w[table == v].sum()) for v in np.unique(table)}
                assert sum(a * a / (b + 1) for a, b in leaves.values()) - g.sum() ** 2 / (w.sum() + 1) == pytest.approx(found)
                assert all(v == pytest.approx(a / (b + 1)) for v, (a, b) in leaves.items())
            else:
                assert not table.any()


def test_scores_add_up_bin_by_bin():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = AdditiveModel(rounds=10, pair_rounds=10).fit(x, y)
    assert model.pairs[0] == (0, 1)
    new = np.vstack([rng.normal(size=(20, 4)), [[-9, 9, 0, 0]]])
    for row, score in zip(new, model.score(new), strict=True):
        total = model.base
        for j, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[sum(row[j] > e for e in edges)]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(row[a] > e for e in model.pair_edges[a]), sum(row[b] > e for e in model.pair_edges[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert (((model.score(x) > 0.5) == y).mean()) > 0.9


ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "no id here"), (None, None), (4, "twice over and over again"), (4, "twice over and over again"), (5, "x" * 100_000), (6, "word " * 20_000)]


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_stages_in_odd_cases(spark, kind):
    import corpus_pipeline

    odd = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = {"odd": odd, "empty": odd.limit(0), "clashing": odd.selectExpr("*", "1 as score", "2 as fp", "3 as key", "4 as n_lines", "5 as sequence_id", "6 as component_id", "7 as item_id", "8 as start")}[kind]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            pieces = out.collect()
            assert {r["doc_id"] for r in pieces} == ({i for i, _ in ODD} if kind != "empty" else set())
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
