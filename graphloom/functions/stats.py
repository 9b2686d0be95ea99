"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_odds_z(c1: Column, n1: Column, c2: Column, n2: Column, prior: float = 0.5) -> Column:
    """Variance-adjusted log-odds ratio of a term in two groups, with a flat prior."""
    a1, a2 = c1 + prior, c2 + prior
    b1, b2 = n1 - c1 + prior, n2 - c2 + prior
    return (F.ln(a1 / b1) - F.ln(a2 / b2)) / F.sqrt(1 / a1 + 1 / a2)


def share(part: Column, whole: Column) -> Column:
    """part / whole, null if the whole is 0."""
    return F.when(whole != 0, part / whole)


def kappa(agreed: Column, expected: Column) -> Column:
    """Cohen's kappa; 1 if agreement by chance is certain."""
    return F.when(expected == 1, F.lit(1.0)).otherwise((agreed - expected) / (1 - expected))
