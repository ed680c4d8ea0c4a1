"""Digamma, log-gamma and their compositions, as numpy functions and as Column expressions.

Both use one series: the argument is shifted up by SHIFT with the recurrence, then an
asymptotic expansion is exact to about 1e-13. Nothing here leaves generated code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6
#: Coefficients of y**-2, y**-4, ... of ln(y) - 1/(2y) - digamma(y), and of y**-1, y**-3, ... in Stirling's series.
PSI_TERMS = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 5 / 660, -691 / 32760)
GAMMA_TERMS = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
HALF_LOG_TAU = 0.5 * math.log(2 * math.pi)


def digamma(x):
    """Digamma of positive numbers (numpy)."""
    x = np.asarray(x, float)
    y, out = x + SHIFT, np.zeros_like(x)
    for i in range(SHIFT):
        out -= 1.0 / (x + i)
    inv = 1.0 / (y * y)
    power = inv.copy() if isinstance(inv, np.ndarray) else inv
    out = out + np.log(y) - 0.5 / y
    for c in PSI_TERMS:
        out = out - c * power
        power = power * inv
    return out


def lgamma(x):
    """Log-gamma of positive numbers (numpy)."""
    x = np.asarray(x, float)
    y = x + SHIFT
    out = (y - 0.5) * np.log(y) - y + HALF_LOG_TAU
    for i in range(SHIFT):
        out = out - np.log(x + i)
    inv = 1.0 / (y * y)
    power = 1.0 / y
    for c in GAMMA_TERMS:
        out = out + c * power
        power = power * inv
    return out


def dirichlet_expectation(m):
    """E[log theta] of each row of Dirichlet parameters (numpy); a single row may be one-dimensional."""
    m = np.asarray(m, float)
    return digamma(m) - digamma(m.sum(-1, keepdims=True))


def log_sum_exp(x, axis=-1):
    top = np.max(x, axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def digamma_col(x: Column) -> Column:
    x = x.cast("double")
    y = x + float(SHIFT)
    out = F.ln(y) - F.lit(0.5) / y
    inv = F.lit(1.0) / (y * y)
    power = inv
    for c in PSI_TERMS:
        out = out - F.lit(c) * power
        power = power * inv
    for i in range(SHIFT):
        out = out - F.lit(1.0) / (x + float(i))
    return out


def lgamma_col(x: Column) -> Column:
    x = x.cast("double")
    y = x + float(SHIFT)
    out = (y - 0.5) * F.ln(y) - y + F.lit(HALF_LOG_TAU)
    inv = F.lit(1.0) / (y * y)
    power = F.lit(1.0) / y
    for c in GAMMA_TERMS:
        out = out + F.lit(c) * power
        power = power * inv
    for i in range(SHIFT):
        out = out - F.ln(x + float(i))
    return out


def digamma_sql(x: str) -> str:
    """The same digamma as DuckDB text, for oracles."""
    y = f"({x} + {float(SHIFT)!r}::DOUBLE)"
    terms = "".join(f" - ({c!r}::DOUBLE) / ({y} ** {2 * k + 2})" for k, c in enumerate(PSI_TERMS))
    steps = "".join(f" - 1.0::DOUBLE / ({x} + {float(i)!r}::DOUBLE)" for i in range(SHIFT))
    return f"(ln({y}) - 0.5::DOUBLE / {y}{terms}{steps})"


def lgamma_sql(x: str) -> str:
    y = f"({x} + {float(SHIFT)!r}::DOUBLE)"
    terms = "".join(f" + ({c!r}::DOUBLE) / ({y} ** {2 * k + 1})" for k, c in enumerate(GAMMA_TERMS))
    steps = "".join(f" - ln({x} + {float(i)!r}::DOUBLE)" for i in range(SHIFT))
    return f"((({y}) - 0.5::DOUBLE) * ln({y}) - {y} + {HALF_LOG_TAU!r}::DOUBLE{terms}{steps})"


def log_sum_exp_col(xs: Column) -> Column:
    """ln of the sum of exponentials of an array, safe against overflow; null for an empty array."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
