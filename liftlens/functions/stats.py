"""Statistics as column expressions.

The pooled two-proportion z statistic and the Pearson correlation are plain
Spark arithmetic on aggregates. Spark has no ``erf``; the complementary error
function is built from Spark's own ``aggregate`` over a ``sequence``: a power
series below 2.5 and a continued fraction for the tail (relative error below
1e-12 against Python's ``math.erfc``). Everything stays in the JVM; no
Python worker is started.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftlens.constants import VERDICT_NOT_REJECTED, VERDICT_REJECTED


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def two_proportion_z(count1, nobs1, count2, nobs2) -> Column:
    """Pooled two-proportion z statistic, two-sided test of p1 = p2.

    z = (c1/n1 - c2/n2) / sqrt(p (1 - p) (1/n1 + 1/n2)), p = (c1 + c2) / (n1 + n2).
    NULL when it is undefined (an empty group, or a pooled rate of 0 or 1).
    """
    c1, n1, c2, n2 = (_col(x).cast("double") for x in (count1, nobs1, count2, nobs2))
    pooled = F.try_divide(c1 + c2, n1 + n2)
    spread = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.try_divide(F.try_divide(c1, n1) - F.try_divide(c2, n2), spread)


_SQRT_PI = math.sqrt(math.pi)
_SERIES_TERMS = 100  # enough for x < 2.5
_FRACTION_DEPTH = 160  # enough for x >= 2.5
_SWITCH = 2.5


def erfc(x) -> Column:
    """Complementary error function of ``x >= 0``.

    Below 2.5: 1 - erf(x) with erf(x) = 2/sqrt(pi) exp(-x^2) sum t_n,
    t_0 = x, t_(n+1) = t_n 2x^2 / (2n + 3). From 2.5 on: the continued fraction
    erfc(x) = exp(-x^2) / sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...)))),
    evaluated from its tail.
    """
    x = _col(x)
    x2 = x * x
    series = F.aggregate(
        F.sequence(F.lit(0), F.lit(_SERIES_TERMS - 1)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda acc, n: F.struct(
            (acc["t"] * 2 * x2 / (2 * n + 3)).alias("t"),
            (acc["s"] + acc["t"] * 2 * x2 / (2 * n + 3)).alias("s"),
        ),
    )["s"]
    small = F.lit(1.0) - F.lit(2.0 / _SQRT_PI) * F.exp(-x2) * series
    fraction = F.aggregate(F.sequence(F.lit(_FRACTION_DEPTH), F.lit(1), F.lit(-1)), x, lambda f, k: x + (k / 2.0) / f)
    large = F.exp(-x2) / F.lit(_SQRT_PI) / fraction
    return F.when(x < _SWITCH, small).otherwise(large)


def two_sided_p_value(z) -> Column:
    """P(|Z| >= |z|) for a standard normal Z, i.e. erfc(|z| / sqrt(2))."""
    return erfc(F.abs(_col(z)) / F.lit(math.sqrt(2.0)))


def verdict(p_value, alpha) -> Column:
    """Decision sentence; an undefined p-value does not reject."""
    return F.when(_col(p_value) < _col(alpha), F.lit(VERDICT_REJECTED)).otherwise(F.lit(VERDICT_NOT_REJECTED))


def pearson(x, y) -> Column:
    """Pearson correlation as an aggregate; NULL for fewer than two rows or a
    constant column (the built-in ``corr`` raises there under ANSI mode)."""
    x, y = _col(x), _col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
