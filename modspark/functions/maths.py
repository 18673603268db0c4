"""Numeric, array and map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(a: Column) -> Column:
    """Softmax over an array, shifted by its maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _units(x: Column, digits: int) -> Column:
    """``x >= 0`` in whole units of the last digit (up to four), rounded half to even on the
    exact binary value (the rule of C and of float formatting).

    Whole part, fraction and the fraction scaled by a power of two are all exact.
    """
    ones = F.floor(x)
    scaled = (x - ones) * float(2**46)
    n = F.floor(scaled)
    product = n * 10**digits
    tail = F.shiftright(product, 46)
    rest = (product - tail * 2**46 - 2**45).cast("double")
    past_half = rest + (scaled - n) * float(10**digits)
    units = ones * 10**digits + tail
    up = (past_half > 0) | ((past_half == 0) & (units % 2 == 1))
    return F.when(up, units + 1).otherwise(units)


def round_exact(x: Column, digits: int) -> Column:
    return _units(x, digits) / float(10**digits)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text of a number, as ``%.nf`` writes it."""
    units = _units(x, digits)
    if digits == 0:
        return units.cast("string")
    whole = F.floor(units / 10**digits).cast("string")
    part = F.lpad((units % 10**digits).cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), part)


def weighted_bce(logit: Column, y: Column, weight: Column | float = 1.0) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * y * softplus(-logit) + (1 - y) * softplus(logit)


def focal(bce: Column, gamma: float = 2.0) -> Column:
    return F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce


def perplexity(loss: Column) -> Column:
    return F.when(loss < 20, F.exp(loss)).otherwise(F.lit(float("inf")))


def mean_cost(total: Column, n: Column) -> Column:
    """Whole units per item, ``n`` at least one."""
    return F.floor(total / F.greatest(n, F.lit(1))).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a wall-clock timestamp, independent of the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_millis(ts: Column) -> Column:
    whole = F.extract(F.lit("SECOND"), ts)  # decimal(8, 6) with the fraction
    millis = F.floor(whole * 1000).cast("long")
    return (epoch_seconds(ts) - F.second(ts)) * 1000 + millis
