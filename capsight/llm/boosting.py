"""Gradient-boosted trees over counted patterns of small integer features.

A pattern is one combination of feature values; the number of different ones is bounded by the
product of the features' ranges, whatever the number of rows. Training on patterns with their
counts is therefore training on all rows, and the fitted trees are plain SQL expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, SHRINK = 24, 3, 0.3, 1.0


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    """Rows with ``feature`` up to ``at`` go to ``low``, the others to ``high``."""

    feature: int
    at: int
    low: Leaf | Split
    high: Leaf | Split


@dataclass
class Trees:
    names: tuple[str, ...]
    bias: float
    trees: list[Leaf | Split]

    def margin(self, pattern: Sequence[int]) -> float:
        total = self.bias
        for node in self.trees:
            while isinstance(node, Split):
                node = node.low if pattern[node.feature] <= node.at else node.high
            total += node.value
        return total

    def probability(self, features: Column) -> Column:
        """The probability as an expression over a struct with the named features."""
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + self._expression(tree, features)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def _expression(self, node: Leaf | Split, features: Column) -> Column:
        if isinstance(node, Leaf):
            return F.lit(node.value)
        low, high = self._expression(node.low, features), self._expression(node.high, features)
        return F.when(features[self.names[node.feature]] <= node.at, low).otherwise(high)


def probability(margin: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))


def _grow(rows: list[tuple[Sequence[int], float, float]], depth: int) -> Leaf | Split:
    """A tree for rows of (pattern, gradient, curvature): second-order gains, smallest feature and cut first."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for feature in range(len(rows[0][0])):
            by_value: dict[int, list[float]] = {}
            for pattern, gradient, curvature in rows:
                sums = by_value.setdefault(pattern[feature], [0.0, 0.0])
                sums[0] += gradient
                sums[1] += curvature
            gl = hl = 0.0
            for value in sorted(by_value)[:-1]:
                gl += by_value[value][0]
                hl += by_value[value][1]
                gain = gl**2 / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g**2 / (h + SHRINK)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, feature, value)
    if best is None:
        return Leaf(RATE * g / (h + SHRINK))
    _, feature, at = best
    low = [r for r in rows if r[0][feature] <= at]
    high = [r for r in rows if r[0][feature] > at]
    return Split(feature, at, _grow(low, depth - 1), _grow(high, depth - 1))


def train(names: Iterable[str], patterns: list[tuple[tuple[int, ...], float, float]]) -> Trees:
    """Trees for (pattern, positive rows, negative rows), which may be weighed; without rows every probability is a half."""
    names = tuple(names)
    patterns = sorted(p for p in patterns if p[1] or p[2])
    positive, negative = sum(p[1] for p in patterns), sum(p[2] for p in patterns)
    model = Trees(names, math.log((positive + 1) / (negative + 1)), [])
    margins = [model.bias] * len(patterns)
    for _ in range(ROUNDS if patterns else 0):
        rows = []
        for (pattern, pos, neg), margin in zip(patterns, margins, strict=True):
            p = probability(margin)
            rows.append((pattern, pos - (pos + neg) * p, (pos + neg) * p * (1 - p)))
        tree = _grow(rows, DEPTH)
        if isinstance(tree, Leaf):
            break
        model.trees.append(tree)
        margins = [m + Trees(names, 0.0, [tree]).margin(p[0]) for p, m in zip(patterns, margins, strict=True)]
    return model


def threshold(model: Trees, patterns: list[tuple[tuple[int, ...], float, float]], precision: float) -> float:
    """The lowest probability from which the rows of the patterns are positive in at least this share; 1.1 if none is."""
    scored = sorted(((probability(model.margin(p)), pos, neg) for p, pos, neg in patterns), reverse=True)
    best, good, bad = 1.1, 0, 0
    for k, (p, pos, neg) in enumerate(scored):
        good, bad = good + pos, bad + neg
        last = k + 1 == len(scored) or scored[k + 1][0] < p
        if last and good >= precision * (good + bad) and good:
            best = p
    return best
