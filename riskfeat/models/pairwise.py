"""Gradients of the pairwise ranking loss without pairs.

The loss adds log(1 + exp(-(s_i - s_j))) over all rows i with label 1 and j with label 0. What
a row gets from all rows of the other label is a smooth function of its own margin: the sum of
a logistic curve around each of the others' margins. Such a function is known everywhere from
its values at a few Chebyshev points. So one aggregate adds up the curves at these points, the
driver turns the sums into polynomials, and every row evaluates its own: no join, no shuffle of
rows, no pairs. The number of points follows from the range of the margins and the tolerance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-11
#: The range of margins is taken a little wider, so that rounding leaves no margin outside.
SLACK = 1e-9
#: Up to so many points the recurrence is written out, a column for each step.
WRITTEN_OUT = 32


def points_needed(half: float, tolerance: float = TOLERANCE) -> int:
    """The curve has its nearest poles pi away from the real line, which fixes the rate at
    which the polynomials converge on a range of twice ``half``."""
    ratio = math.pi / half
    rate = ratio + math.sqrt(ratio * ratio + 1)
    return max(4, math.ceil(-math.log(tolerance) / math.log(rate)) + 4)


def curve(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


@dataclass(frozen=True)
class PairGradients:
    """First and second derivative of the loss by a row's margin, for rows of either label.

    ``ones`` and ``zeros`` hold a pair of coefficients for each Chebyshev polynomial.
    """

    middle: float
    half: float
    ones: list[tuple[float, float]]
    zeros: list[tuple[float, float]]

    @classmethod
    def fit(cls, rows: DataFrame, label: str, margin: str, tolerance: float = TOLERANCE) -> PairGradients | None:
        """None where one of the labels is missing: there is no pair then."""
        ends = rows.where(F.col(label).isin(0, 1)).agg(
            F.min(margin), F.max(margin), F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
        ).first()
        low, high, n1, n0 = ends
        if not n1 or not n0:
            return None
        middle, half = (low + high) / 2, (high - low) / 2 + max(SLACK, SLACK * abs(high - low))
        half = max(half, 0.05)
        n = points_needed(half, tolerance)
        angles = (np.arange(n) + 0.5) * np.pi / n
        points = middle + half * np.cos(angles)
        at = F.get(F.lit(points.tolist()), F.col("point"))
        other = F.col(margin).cast("double")
        up = curve(F.when(F.col(label) == 0, other - at).otherwise(at - other))
        sums = (
            rows.where(F.col(label).isin(0, 1)).select(label, margin, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
            .groupBy("point", label).agg(F.sum(up).alias("first"), F.sum(up * (1 - up)).alias("second"))
        ).collect()  # two rows a point
        values = np.zeros((2, n, 2))
        for point, y, first, second in sums:
            values[int(y), point] = first, second
        basis = np.cos(np.outer(np.arange(n), angles)) * (2 / n)
        basis[0] /= 2
        # each pair counts as often as it would be drawn if every row drew one partner
        weight = 1 / n1 + 1 / n0
        from_zeros, from_ones = weight * basis @ values[0], weight * basis @ values[1]
        return cls(middle, half, (from_zeros * [-1, 1]).tolist(), from_ones.tolist())

    def columns(self, label: str, margin: str) -> tuple[Column, Column]:
        """(first, second) derivative of each row; rows with another label get 0."""
        x = (F.col(margin) - F.lit(self.middle)) / F.lit(self.half)
        own = F.when(F.col(label) == 1, F.lit(self._flat(self.ones))).otherwise(F.lit(self._flat(self.zeros)))
        n = len(self.ones)
        # Clenshaw's recurrence from the highest polynomial down, for both derivatives at once
        start = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "b", "c", "d")])
        steps = F.sequence(F.lit(n - 1), F.lit(1))

        def step(s: Column, k: Column) -> Column:
            return F.struct(
                (F.get(own, 2 * k) + 2 * x * s.a - s.b).alias("a"), s.a.alias("b"),
                (F.get(own, 2 * k + 1) + 2 * x * s.c - s.d).alias("c"), s.c.alias("d"),
            )

        def finish(s: Column) -> Column:
            return F.struct((F.get(own, F.lit(0)) + x * s.a - s.b).alias("g"), (F.get(own, F.lit(1)) + x * s.c - s.d).alias("h"))

        both = F.aggregate(steps, start, step, finish)
        known = F.col(label).isin(0, 1)
        return F.when(known, both.g).otherwise(0.0), F.when(known, both.h).otherwise(0.0)

    def added(self, df: DataFrame, label: str, margin: str, first: str, second: str) -> DataFrame:
        """``first`` and ``second``: the two derivatives beside the columns of ``df``.

        The same sums as ``columns``, but each step of the recurrence is a column of its own: it
        is compiled and evaluated once, where an array's fold is interpreted for each use.
        """
        n, order = len(self.ones), [c for c in df.columns if c not in (first, second)]
        if n > WRITTEN_OUT:
            return df.withColumns(dict(zip((first, second), self.columns(label, margin))))
        own = F.when(F.col(label) == 1, F.lit(self._flat(self.ones))).otherwise(F.lit(self._flat(self.zeros)))
        df = df.withColumn("own__", own).withColumn("x__", (F.col(margin) - F.get(F.lit([self.middle, self.half]), F.lit(0))) / F.get(F.lit([self.middle, self.half]), F.lit(1)))
        x, last = F.col("x__"), {0: (F.lit(0.0), F.lit(0.0)), 1: (F.lit(0.0), F.lit(0.0))}
        for k in range(n - 1, 0, -1):
            df = df.withColumns({f"at{k}_{i}__": F.get("own__", F.lit(2 * k + i)) + 2 * x * a - b for i, (a, b) in last.items()})
            last = {i: (F.col(f"at{k}_{i}__"), a) for i, (a, _) in last.items()}
        known = F.col(label).isin(0, 1)
        sums = {i: F.get("own__", F.lit(i)) + x * a - b for i, (a, b) in last.items()}
        return df.select(*order, *[F.when(known, sums[i]).otherwise(0.0).alias(c) for i, c in enumerate((first, second))])

    @staticmethod
    def _flat(pairs: list[tuple[float, float]]) -> list[float]:
        return [float(v) for pair in pairs for v in pair]
