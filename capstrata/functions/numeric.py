"""Exact parsing and comparison as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_number(s: Column) -> Column:
    """Finite decimal, NULL for anything else (NaN and infinities included).

    Up to 20 digits before and 18 after the point are kept, which covers nanosecond times; a number
    beyond that range is NULL as well, for the type cannot hold it.
    """
    return F.trim(s).try_cast("decimal(38,18)")


def exact_integer(s: Column) -> Column:
    """Whole number or NULL; a fraction is refused, never rounded, however small it is."""
    text, d = F.trim(s), exact_number(s)
    part = lambda pattern: F.regexp_extract(text, pattern, 1)
    left, right = F.length(F.regexp_extract(part(r"^[+-]?(\d*)"), "(0*)$", 1)), F.length(F.regexp_replace(part(r"\.(\d*)"), "0+$", ""))
    exponent = F.coalesce(part(r"[eE]([+-]?\d+)$").try_cast("int"), F.lit(0))
    zero = text.rlike(r"^[+-]?[0.]+([eE].*)?$")
    whole = F.when(right > 0, right <= exponent).otherwise(left >= -exponent)
    return F.when(zero | whole, d.try_cast("bigint"))


def rational(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def equivalent(a: Column, b: Column, floating: bool) -> Column:
    """Equality of a stored and a recomputed value: exact, floats within 1e-12 rel / 1e-10 abs."""
    if not floating:
        return a.eqNullSafe(b)
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    close = F.abs(a - b) <= F.greatest(F.lit(1e-12) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-10))
    return (a.isNull() & b.isNull()) | F.coalesce(finite & close, F.lit(False))


def round6(c: Column) -> Column:
    """Six decimals with the same IEEE steps in every engine, no negative zero.

    The rounding point lies just below one half, so sums of short decimals that differ in
    their last bit still round alike.
    """
    return F.floor(c * 1e6 + 0.5003).cast("double") / F.lit(1e6)


def within_interval(value: Column, lower: Column, upper: Column,
                    lower_inclusive: Column, upper_inclusive: Column) -> Column:
    above = (value > lower) | (lower_inclusive & (value == lower))
    below = (value < upper) | (upper_inclusive & (value == upper))
    return above & below


def bottom_offset_interval(offset: Column, normal_y: Column, lower: Column, upper: Column,
                           lower_inclusive: Column, upper_inclusive: Column) -> Column:
    """Signed plane-distance interval of a cover's underside for a thickness interval.

    The ends swap with their inclusivity unless the plane normal points down.
    """
    near, far = offset - normal_y * lower, offset - normal_y * upper

    def interval(lo, up, lo_inc, up_inc):
        return F.struct(lo.alias("lower_m"), up.alias("upper_m"),
                        lo_inc.alias("lower_inclusive"), up_inc.alias("upper_inclusive"))

    yes = F.lit(True)
    return (F.when(normal_y < 0, interval(near, far, lower_inclusive, upper_inclusive))
            .when(normal_y == 0, interval(offset, offset, yes, yes))
            .otherwise(interval(far, near, upper_inclusive, lower_inclusive)))
