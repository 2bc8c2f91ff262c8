"""Shapley values of trees against their definition over all sets of inputs."""

from itertools import combinations
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.features import category_map, encode
from millrace.operators import dataset, model, shapley
from millrace.sources.events import synthetic
from millrace.spec import MODEL_INPUTS


def expected(node, row, known, values):
    """The tree's expectation with the known inputs given, node by node."""
    if node.numDescendants() == 0:
        return values(node)
    split = node.split()
    sides = [node.leftChild(), node.rightChild()]
    if split.featureIndex() in known:
        return expected(sides[0 if row[split.featureIndex()] <= split.threshold() else 1], row, known, values)
    whole = node.impurityStats().count()
    return sum(expected(s, row, known, values) * s.impurityStats().count() / whole for s in sides)


def used(node):
    return set() if node.numDescendants() == 0 else {node.split().featureIndex()} | used(node.leftChild()) | used(node.rightChild())


def by_definition(fitted, row):
    boosted = type(fitted).__name__.startswith("GBT")
    weights = fitted.treeWeights if boosted else [1 / len(fitted.trees)] * len(fitted.trees)
    out = np.zeros(len(row))

    def values(node):
        if boosted:
            return node.prediction()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    for tree, weight in zip(fitted.trees, weights, strict=True):
        root = tree._call_java("rootNode")
        inputs = sorted(used(root))
        for f in inputs:
            others = [i for i in inputs if i != f]
            for k in range(len(inputs)):
                share = factorial(k) * factorial(len(inputs) - k - 1) / factorial(len(inputs))
                for chosen in combinations(others, k):
                    gain = expected(root, row, {*chosen, f}, values) - expected(root, row, set(chosen), values)
                    out[f] += weight * share * gain
    return out


@pytest.fixture(scope="module")
def training(spark):
    events = synthetic(spark, n_cards=20, n_events=800, seed=13)
    return dataset.training_set(events).cache()


@pytest.mark.parametrize(("kind", "params"), [("gbt", {"maxIter": 3, "maxDepth": 3}), ("forest", {"numTrees": 3, "maxDepth": 4})])
def test_values_are_those_of_the_definition(spark, training, kind, params):
    maps = category_map(training)
    fitted = model.fit(training, maps, kind, **params)
    last = fitted.stages[-1]
    assert any(used(t._call_java("rootNode")) for t in last.trees)
    scored = model.tree_scorer(fitted, maps)(training.withColumn("contributions_of", F.lit(1)))
    assert {*training.columns, "contributions_of", "score", "base", "contributions"} == set(scored.columns)
    rows = scored.collect()
    assert len(rows) == 800
    plain = {r["transaction_id"]: r["score"] for r in model.score(training, fitted, maps).collect()}
    for r in rows:
        total = r["base"] + sum(r["contributions"])
        assert r["score"] == pytest.approx(1 / (1 + exp(-2 * total)) if kind == "gbt" else total)
        assert r["score"] == plain[r["transaction_id"]]
    for r in encode(training, maps).orderBy("transaction_id").limit(3).collect():
        row = [float(r[c] or 0) for c in MODEL_INPUTS]
        got = next(x["contributions"] for x in rows if x["transaction_id"] == r["transaction_id"])
        assert list(got) == pytest.approx(by_definition(last, row).tolist(), abs=1e-12)


def test_saved_models_and_the_largest_contributions(spark, training, tmp_path):
    maps = category_map(training)
    fitted = model.fit(training, maps, maxIter=2, maxDepth=2)
    model.save(fitted, maps, str(tmp_path / "m"))
    again, _ = model.load(str(tmp_path / "m"))
    one, two = (sorted(model.tree_scorer(m, maps)(training).select("transaction_id", "base", "contributions").collect()) for m in (fitted, again))
    assert one == two
    for r in model.explained(model.tree_scorer(fitted, maps)(training.limit(20)), MODEL_INPUTS, 4).collect():
        parts = r["contributions"].asDict()
        assert [t["feature"] for t in r["top"]] == [n for n, _ in sorted(parts.items(), key=lambda x: (-abs(x[1]), x[0]))[:4]]


def test_values_at_the_ends_of_the_number_line():
    leaves = [shapley.Leaf(2.0, (0,), (-np.inf,), (1.0,), (0.25,)), shapley.Leaf(-1.0, (0,), (1.0,), (np.inf,), (0.75,)), shapley.Leaf(0.5, (), (), (), ())]
    assert shapley.base(leaves) == pytest.approx(0.25)
    rows = np.array([[-np.inf, 0.0], [1.0, 0.0], [np.nextafter(1.0, 2.0), 0.0], [np.inf, 0.0], [np.nan, 0.0]])
    assert shapley.shapley(leaves, rows)[:, 0].tolist() == pytest.approx([2.25, 2.25, -0.75, -0.75, -0.75])
    assert not shapley.shapley(leaves, rows)[:, 1].any() and shapley.shapley(leaves, rows[:0]).shape == (0, 2)


def test_an_empty_table_has_the_columns(spark, training):
    maps = category_map(training)
    fitted = model.fit(training, maps, maxIter=1, maxDepth=1)
    assert model.tree_scorer(fitted, maps)(training.limit(0)).collect() == []
