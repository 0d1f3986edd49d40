"""Numbers of the score and its statistics. NaN is treated as null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes the median absolute deviation of a normal variable its standard deviation.
MAD_TO_SIGMA = 1.4826


def no_nan(value: Column) -> Column:
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def ratio(above: Column, below: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(above.cast("double"), below.cast("double"))


def feature_index(today: Column, base: Column, direction: Column) -> Column:
    """100 x today / base; mirrored at 100 where smaller is better. Null without either value or with a base of 0."""
    index = 100 * ratio(today, base)
    return F.when(direction == -1, 200 - index).otherwise(index)


def health_band(health: Column) -> Column:
    return F.when(health.isNull(), "none").when(health < 95, "bad").when(health > 105, "good").otherwise("normal")


def proportion_margin(p: Column, n: Column) -> Column:
    """Half of the 95 % interval of a proportion."""
    return 1.96 * F.sqrt(ratio(p * (1 - p), n))


def detectable_effect(p: Column, n: Column) -> Column:
    """The smallest difference of proportions seen with the usual power and two samples of ``n``."""
    return 2.8 * F.sqrt(ratio(2 * p * (1 - p), n))


def whole(value: Column) -> Column:
    """Rounded half to even, as a long."""
    return F.bround(value).cast("long")
