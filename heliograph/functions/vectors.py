"""Array expressions on prediction vectors (all in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def active(v: Column) -> Column:
    """some element isn't zero."""
    return F.exists(v, lambda x: x != 0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def rounded(x: Column, digits: int) -> Column:
    """``F.round``, whose decimal of every value only values near a tie, negative or large ones need."""
    scale = float(10**digits)
    steps = x * scale
    plain = (x >= 0) & (steps < 1e8) & (F.abs(steps - F.floor(steps) - 0.5) > 1e-6)
    return F.when(plain, F.floor(steps + 0.5) / scale).otherwise(F.round(x, digits))


def asset_slice(v: Column, position: Column, width: int) -> Column:
    """The part of asset ``position`` (0-based); a vector of just ``width`` elements is the part itself."""
    part = F.slice(v, position * width + 1, F.lit(width))
    return F.when(F.size(v) >= (position + 1) * width, part).when(F.size(v) == width, v)


def sanitised(v: Column, classes: int = 5, eps: float = 1e-6) -> Column:
    """All-zero stays zero; else clip to [eps, 1 - eps], the first ``classes`` scaled to sum 1 (uniform where their sum isn't positive)."""
    safe = F.transform(v, lambda x: clip(x.cast("double"), eps, 1 - eps))
    head, tail = F.slice(safe, 1, classes), F.slice(safe, F.lit(classes + 1), F.greatest(F.size(v) - classes, F.lit(0)))
    scaled = F.when(total(head) > 0, F.transform(head, lambda x: x / total(head))).otherwise(F.array_repeat(F.lit(1.0 / classes), classes))
    return F.when(active(v), F.concat(scaled, tail)).otherwise(F.transform(v, lambda x: x.cast("double") * 0))


def probabilities(v: Column, classes: int = 5, eps: float = 1e-6) -> Column:
    """The first ``classes`` elements clipped from below and divided by their sum."""
    head = F.transform(F.slice(v, 1, classes), lambda x: F.greatest(x.cast("double"), F.lit(eps)))
    return F.transform(head, lambda x: x / total(head))


def argmax(v: Column) -> Column:
    """0-based position of the largest element, the first on ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def logits(v: Column, eps: float = 1e-6) -> Column:
    """Logit of each element; null, NaN and exactly 0 count as 0.5."""
    def one(x: Column) -> Column:
        p = F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(0.5)).otherwise(x.cast("double"))
        c = clip(p, eps, 1 - eps)
        return F.log(c / (1 - c))

    return F.transform(v, one)


def zero_vector(width: int) -> Column:
    """P14."""
    return F.array_repeat(F.lit(0.0), width)


def hit_logits(v: Column, at: int, eps: float = 1e-12) -> Column:
    """Logit of the ``at``-th of a row's probabilities, clipped and normalised over the row; 0 where nothing was submitted or a value is missing."""
    kept = F.transform(v, lambda x: F.greatest(F.least(x.cast("double"), F.lit(1 - eps)), F.lit(eps)))
    rest = total(F.transform(kept, lambda x, i: F.when(i == at, 0.0).otherwise(x)))
    return F.coalesce(F.when(F.exists(v, lambda x: x != 0), F.log(kept[at] / rest)), F.lit(0.0))
