"""Student's t: two-sided p-value as a vectorised function over a handful of test results."""

import pandas as pd
from pyspark.sql import functions as F


def two_sided_p(t, dof):
    """Column of p-values. Everything the workers need is nested here, so it travels with the plan."""

    def fraction(a, b, x):
        # continued fraction of the incomplete beta function
        def floor(v):
            return v if abs(v) > 1e-300 else 1e-300

        c, d = 1.0, 1.0 / floor(1.0 - (a + b) * x / (a + 1.0))
        h = d
        for m in range(1, 400):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for term in (even, odd):
                d = 1.0 / floor(1.0 + term * d)
                c = floor(1.0 + term / c)
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    def p_of(t, dof):
        from math import exp, lgamma, log, log1p

        x = dof / (dof + t * t)
        if x >= 1.0 or x <= 0.0:
            return 1.0 if x >= 1.0 else 0.0
        a, b = dof / 2.0, 0.5
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
        if x < (a + 1) / (a + b + 2):
            return front * fraction(a, b, x) / a
        return 1.0 - front * fraction(b, a, 1 - x) / b

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        known = t.notna() & dof.notna() & (dof >= 1)
        return pd.Series([p_of(a, b) if k else None for a, b, k in zip(t, dof, known)], dtype="float64")

    return p(t, dof)
