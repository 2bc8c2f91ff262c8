"""Exact Shapley values of tree ensembles, for explanations of single scores.

The value of a set of known inputs is the ensemble's expectation with them given: at a split on an
unknown input both sides count, each by its share of the training weight.  Of one leaf this is a
product over the different inputs on its path: 1 or 0 for a known one (does the row pass its
splits?), the share that passes for an unknown one.  The Shapley values of a product need only the
coefficients of a polynomial with one factor for each input of the path, so the work of a row
grows with the leaves and their depth and not with the sets of inputs.

Values add up, with the base, to what is explained: of a forest the probability, of boosted trees
the margin, whose probability is 1 / (1 + exp(-2 margin)).  NaN goes to the right, as in the model.
A model is driver-sized; its leaves go to the tasks with the function.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value, and of each input on its path: bounds (above, up to) and the share that passes."""

    value: float
    inputs: tuple[int, ...]
    above: tuple[float, ...]
    upto: tuple[float, ...]
    share: tuple[float, ...]

    @property
    def expected(self) -> float:
        return self.value * float(np.prod(self.share))


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted boosted or forest classifier of two classes, or of a single tree."""
    trees = model.trees if hasattr(model, "trees") else [model]
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    found: list[Leaf] = []

    def value(node) -> float:
        if boosted:
            return node.prediction()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if sum(stats) else 0.0

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.numDescendants() == 0:
            inputs = tuple(sorted(path))
            above, upto, share = zip(*(path[i] for i in inputs), strict=True) if inputs else ((), (), ())
            found.append(Leaf(weight * value(node), inputs, above, upto, share))
            return
        split = node.split()
        if not hasattr(split, "threshold") or "Continuous" not in split.getClass().getName():
            raise ValueError("only splits at a threshold can be explained")
        i, at, whole = split.featureIndex(), split.threshold(), node.impurityStats().count()
        low, high, passed = path.get(i, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            part = child.impurityStats().count() / whole if whole else 0.5
            walk(child, weight, path | {i: (*bounds, passed * part)})

    for tree, weight in zip(trees, weights, strict=True):
        walk(tree._call_java("rootNode"), weight, {})
    return found


def shapley(found: list[Leaf], rows: np.ndarray) -> np.ndarray:
    """(rows, inputs) of Shapley values."""
    out = np.zeros(rows.shape)
    for leaf in found:
        m = len(leaf.inputs)
        if not m:
            continue
        x = rows[:, leaf.inputs]
        # not (x <= above) rather than x > above: a NaN lies to the right of every threshold
        passed = (np.isneginf(leaf.above) | ~(x <= np.array(leaf.above))) & (np.isposinf(leaf.upto) | (x <= np.array(leaf.upto)))
        known = passed.astype(float)
        order = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for f in range(m):
            # how much weight the sets of k other inputs have, for each k
            sets = np.zeros((len(rows), m))
            sets[:, 0] = 1.0
            for j in range(m):
                if j != f:
                    with_j = np.zeros_like(sets)
                    with_j[:, 1:] = sets[:, :-1] * known[:, j : j + 1]
                    sets = sets * leaf.share[j] + with_j
            out[:, leaf.inputs[f]] += leaf.value * (known[:, f] - leaf.share[f]) * (sets @ order)
    return out


def base(found: list[Leaf]) -> float:
    """The expectation with no input known."""
    return float(sum(leaf.expected for leaf in found))


def contributions(found: list[Leaf], inputs: list[Column]) -> Column:
    """An array with one contribution for each input; only the inputs go to Python, in Arrow batches."""

    n = len(inputs)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), n)
        values = shapley(found, rows)
        ends = np.arange(len(x) + 1, dtype=np.int32) * n
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))

    return run(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in inputs]))
