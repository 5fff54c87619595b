"""Statistics of counts as columns; a zero denominator gives zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.when(_d(den) == 0, F.lit(0.0)).otherwise(_d(num) / _d(den))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn."""
    count = lambda c, n: F.count_if(c).alias(n)
    return [count(predicted & actual, "tp"), count(predicted & ~actual, "fp"), count(~predicted & ~actual, "tn"), count(~predicted & actual, "fn")]


def rates() -> dict[str, Column]:
    """Rates of the columns tp, fp, tn, fn."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    total, precision, recall, base = tp + fp + tn + fn, ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp + fn, tp + fp + tn + fn)
    return {
        "total": total,
        "gold_positives": tp + fn,
        "base_rate": base,
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "accuracy": ratio(tp + tn, total),
        "trivial_f1": ratio(2 * base, 1 + base),
    }


def wilson(successes: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; [0, 1] where nothing was counted."""
    s, t = _d(successes), _d(n)
    p = s / F.when(t > 0, t)
    zz = F.lit(z * z)
    centre, width, scale = p + zz / (2 * t), z * F.sqrt((p * (1 - p) + zz / (4 * t)) / t), 1 + zz / t
    low = F.when(t <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - width) / scale))
    high = F.when(t <= 0, 1.0).otherwise(F.least(F.lit(1.0), (centre + width) / scale))
    return low, high


def floor_index(values: Column, q: float) -> Column:
    """The value at the 0-based index int(q n); 0 if empty."""
    n = F.size(values)
    return F.when(n == 0, 0.0).otherwise(F.get(values, F.least(n - 1, F.floor(F.lit(q) * n).cast("int"))))
