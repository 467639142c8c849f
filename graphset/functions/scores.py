"""Score formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Means and deviations that the penalised score is normalised with: logP, SA, cycle.  Fixed values.
LOGP, SA, CYCLE = (2.4570953396190123, 1.434324401111988), (-3.0525811293166134, 0.8335207024513095), (-0.0485696876403053, 0.2860212110245455)


def complexity_penalty(n: Column, chiral: Column, spiro: Column, bridge: Column, macro: Column) -> Column:
    """-(n**1.005 - n) - log10(chiral + 1) - log10(spiro + 1) - log10(bridge + 1) - [macro > 0] log10 2."""
    size = F.pow(n.cast("double"), F.lit(1.005)) - n
    return -size - F.log10(chiral + 1) - F.log10(spiro + 1) - F.log10(bridge + 1) - F.when(macro > 0, F.log10(F.lit(2.0))).otherwise(0.0)


def density_bonus(n: Column, m: Column) -> Column:
    """Half the logarithm of vertices per distinct identifier, where there are more vertices."""
    return F.when(n > m, 0.5 * F.ln(n / m)).otherwise(0.0)


def sa_score(raw: Column) -> Column:
    """A raw score of -4 … 2.5 on the scale 10 … 1, smoothed above 8."""
    x = 11.0 - (raw + 4.0 + 1.0) / 6.5 * 9.0
    x = F.when(x > 8.0, 8.0 + F.ln(x - 8.0)).otherwise(x)
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), x))


def penalized_score(log_p: Column, sa: Column, longest: Column) -> Column:
    cycle = -F.greatest(longest - 6, F.lit(0))
    return (log_p - LOGP[0]) / LOGP[1] + (-sa - SA[0]) / SA[1] + (cycle - CYCLE[0]) / CYCLE[1]


def qed_sa(qed: Column, sa: Column, ratio: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), qed - ratio * sa)


def size_score(n: Column) -> Column:
    return n / 100


def is_done(score: Column, previous: Column, size: Column, candidates: Column, threshold: float, length: int) -> Column:
    """A walk ends at the threshold, when the score falls, beyond the length, or without a candidate."""
    return (score >= threshold) | (previous > score) | (size > length) | (candidates == 0)
