"""Column expressions shared by the operators. All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(s) -> Column:
    """Deterministic U[0,1) from the first 32 bits of md5(s)."""
    return F.conv(F.substring(F.md5(_c(s)), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_key(seed, key) -> Column:
    """md5(seed ':' key): the ordering key of shuffles, splits and samples."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _c(key).cast("string")))


def r6(c) -> Column:
    """Round a double to 6 places (report precision and oracle comparison)."""
    return F.round(_c(c).cast("double"), 6)


def r6_quick(c) -> Column:
    """r6 for columns of very many rows: the same value without decimal arithmetic, but for values near the
    middle of two results, and very large ones."""
    x = _c(c).cast("double")
    scaled = x * 1e6
    n = F.floor(scaled + 0.5)
    plain = (F.abs(x) < 1e9) & (F.abs(scaled + 0.5 - n - 0.5) < 0.49)
    return F.when(plain, n / F.lit(1e6)).otherwise(r6(x))


def safe_div(num, den) -> Column:
    """num / den, 0.0 where the denominator is 0 (zero_division=0)."""
    num, den = _c(num), _c(den)
    return F.when(den != 0, num.cast("double") / den).otherwise(F.lit(0.0))


def snippet(text, n: int) -> Column:
    """First n characters followed by '...' (always appended)."""
    return F.concat(F.substring(_c(text), 1, n), F.lit("..."))


def label_display(label, positive_name: str = "Stereotype", negative_name: str = "Non-Stereotype") -> Column:
    """1 -> positive name, 0 -> negative name, any other value as text."""
    s = _c(label).cast("string")
    return F.when(s == "1", F.lit(positive_name)).when(s == "0", F.lit(negative_name)).otherwise(s)


# Chi-square(1) critical values for p = 0.001, 0.01, 0.05.
CHI2_1_CRIT_001 = 10.827566170662733
CHI2_1_CRIT_01 = 6.6348966010212145
CHI2_1_CRIT_05 = 3.841458820694124


def significance_stars(chi2) -> Column:
    """'***' / '**' / '*' / 'ns' for p < .001 / .01 / .05, from the statistic
    itself (p is monotone in chi2), so no p-value is needed in the JVM."""
    x = _c(chi2)
    return (F.when(x > CHI2_1_CRIT_001, "***").when(x > CHI2_1_CRIT_01, "**")
            .when(x > CHI2_1_CRIT_05, "*").otherwise("ns"))


# Terms of the series and levels of the continued fraction: rounding error is all that is left.
SERIES_TERMS, FRACTION_LEVELS = 45, 60


def chi2_1_sf(chi2) -> Column:
    """P(chi-square with 1 degree of freedom > x) = erfc(sqrt(x / 2)), null for null. Below 8 one less the
    series of erf in products of x / 3, x / 5, ...; from there the continued
    fraction of erfc with the parts 1 / x, 2 / x, ...; both from the inside out."""
    x = F.greatest(_c(chi2).cast("double"), F.lit(0.0))
    x = F.when(_c(chi2).isNotNull(), x)
    inward = F.sequence(F.lit(SERIES_TERMS), F.lit(1))
    series = F.aggregate(inward, F.lit(1.0), lambda acc, k: F.lit(1.0) + x / (2 * k + 1) * acc)
    inward = F.sequence(F.lit(FRACTION_LEVELS), F.lit(1))
    fraction = F.aggregate(inward, F.lit(1.0), lambda acc, k: F.lit(1.0) + k / x / acc)
    small = F.lit(1.0) - F.sqrt(x * (2.0 / math.pi)) * F.exp(-x / 2) * series
    return F.when(x < 8.0, small).otherwise(F.exp(-x / 2) / F.sqrt(x * (math.pi / 2)) / fraction)


def safe_partition_name(group) -> Column:
    """Folder-safe group name: '/' becomes '_'."""
    return F.regexp_replace(_c(group), "/", "_")
