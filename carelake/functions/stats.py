"""Statistical Column helpers (built-in expressions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17 coefficients for the standard
# normal CDF (absolute error < 7.5e-8). Spark SQL has no erf().
AS_P = 0.2316419
AS_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Phi(z); null stays null."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * a)
    poly = t * (F.lit(AS_B[0]) + t * (F.lit(AS_B[1]) + t * (F.lit(AS_B[2]) + t * (F.lit(AS_B[3]) + t * F.lit(AS_B[4])))))
    upper = F.lit(INV_SQRT_2PI) * F.exp(-(a * a) / 2) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)
