"""Column expressions that the operators are made of; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan_number(scan: Column, name: str, kind: str = "bigint") -> Column:
    """The first ``name=<digits>`` of a scan's description. A description without it is an error, as in a plain cast of ''."""
    return F.regexp_extract(scan, rf"{name}=(\d+)", 1).cast(kind)


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def log_intensity(x: Column) -> Column:
    """log10(1 + x), in double precision."""
    return F.log10(F.lit(1.0) + x.cast("double"))


def at_most(x: Column, limit: float, kind: str) -> Column:
    """x <= limit, compared in x's own precision; null and NaN fail."""
    return x <= F.lit(limit).cast("float" if kind == "float" else "double")


def packed_digits(charge: Column) -> Column:
    """Aggregate: the distinct charges as text, in the order of text, one after the other, as a number; nulls are skipped."""
    joined = F.concat_ws("", F.array_sort(F.collect_set(charge.cast("string"))))
    return F.nullif(joined, F.lit("")).cast("bigint")


def digits_within(found: Column, allowed: Column) -> Column:
    """Whether each digit of ``found`` is one of ``allowed``'s; a null or non-positive number has no digits to miss."""
    digits = F.filter(F.split(found.cast("string"), ""), lambda d: d != "")
    held = F.forall(digits, lambda d: F.contains(allowed.cast("string"), d))
    return F.when(found.isNull() | (found <= 0), F.lit(True)).otherwise(F.coalesce(held, F.lit(False)))


def edges(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 evenly spaced edges, the last one exactly ``high``."""
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def widened(low: float, high: float) -> tuple[float, float]:
    """A range of one value gets a little room on both sides."""
    if low != high:
        return low, high
    # The room, since bins depend on it.
    room = max(abs(low) * 1e-6, 1e-6)
    return low - room, high + room


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin of finite x: edges belong to the bin on their right, the last edge to the last bin; null outside.

    Division gives a guess that rounding may put one off, so it is put right with the edges themselves.
    """
    step = (high - low) / bins
    edge = lambda k: F.when(k == bins, F.lit(high)).otherwise(F.lit(low) + k * F.lit(step))
    guess = F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(bins - 1)).cast("int")
    right = F.when((guess < bins - 1) & (edge(guess + 1) <= x), 1).otherwise(0)
    left = F.when(edge(guess) > x, 1).otherwise(0)
    return F.when((x >= low) & (x <= high), guess + right - left)
