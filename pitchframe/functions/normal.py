"""Standard normal distribution in native expressions.

Spark has no error function, so the two curves are written as published
rational approximations with double precision: Hart's for the distribution
function and Wichura's AS 241 for its inverse.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients, highest power first.
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
AS241_CENTRE_NUMERATOR = [
    2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
    1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0,
]
AS241_CENTRE_DENOMINATOR = [
    5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
    5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0,
]
AS241_NEAR_NUMERATOR = [
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
    3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0,
]
AS241_NEAR_DENOMINATOR = [
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0,
]
AS241_FAR_NUMERATOR = [
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e+0, 5.46378491116411436990e+0, 6.65790464350110377720e+0,
]
AS241_FAR_DENOMINATOR = [
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
]


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def add_normal_cdf(df: DataFrame, x: str, out: str) -> DataFrame:
    """Adds P(Z <= x).

    The argument is used many times, so it gets a column of its own in an
    earlier projection; nested in one expression the tree would explode.
    """
    df = df.withColumn("_size", F.abs(x)).withColumn("_density", F.exp(-F.col("_size") * F.col("_size") / 2.0))
    size, density = F.col("_size"), F.col("_density")
    near = density * _polynomial(HART_NUMERATOR, size) / _polynomial(HART_DENOMINATOR, size)
    tail = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = size + F.lit(k) / tail
    far = density / (tail * math.sqrt(2 * math.pi))
    upper = F.when(size > 37.0, F.lit(0.0)).when(size < 7.07106781186547, near).otherwise(far)
    df = df.withColumn("_upper", upper)
    value = F.when(F.col(x) > 0, F.lit(1.0) - F.col("_upper")).otherwise(F.col("_upper"))
    return df.withColumn(out, value).drop("_size", "_density", "_upper")


def add_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the inverse of the distribution function; 0 where it would be infinite (p of 0 or 1)."""
    chance = F.col(p)
    inside = F.when((chance > 0) & (chance < 1), F.least(chance, F.lit(1.0) - chance)).otherwise(F.lit(0.5))
    df = df.withColumns({"_q": chance - 0.5, "_t": F.sqrt(-F.log(inside))})
    df = df.withColumns(
        {"_r": F.lit(0.180625) - F.col("_q") * F.col("_q"), "_near": F.col("_t") - 1.6, "_far": F.col("_t") - 5.0}
    )
    q, t, r, near, far = (F.col(c) for c in ("_q", "_t", "_r", "_near", "_far"))
    centre = q * _polynomial(AS241_CENTRE_NUMERATOR, r) / _polynomial(AS241_CENTRE_DENOMINATOR, r)
    middle = _polynomial(AS241_NEAR_NUMERATOR, near) / _polynomial(AS241_NEAR_DENOMINATOR, near)
    outer = _polynomial(AS241_FAR_NUMERATOR, far) / _polynomial(AS241_FAR_DENOMINATOR, far)
    value = F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * F.when(t <= 5.0, middle).otherwise(outer))
    value = F.when(chance.isNull(), F.lit(None)).when((chance > 0) & (chance < 1), value).otherwise(F.lit(0.0))
    return df.withColumn(out, value).drop("_q", "_t", "_r", "_near", "_far")
