"""Score functions: bounds, utilities, sample-weight classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
# Methods in order of cost, the tie-break everywhere.
METHODS = ("vector", "lightrag", "pathrag")
# Weight of a question by how many methods answer it well enough.
CLASS_WEIGHTS = {"stable": 1.0, "ambiguous": 0.5, "all_failed": 0.3}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def close(a: Column, b: Column, eps: float = TINY) -> Column:
    return F.abs(a - b) <= eps


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))


# Names and formulas of the utilities that a configuration can name.
UTILITIES = {
    "harmonic": harmonic,
    "geometric": lambda a, b: F.sqrt(a * b),
    "minimum": lambda a, b: F.least(a, b),
    "mean": lambda a, b: (a + b) / 2,
    "ac75_er25": lambda a, b: 0.75 * a + 0.25 * b,
    "ac60_er40": lambda a, b: 0.60 * a + 0.40 * b,
}


def method_rank(method: Column) -> Column:
    """Position in the cost order; unknown methods come last."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, m in enumerate(METHODS) for x in (m, k)]), method), F.lit(len(METHODS)))


def weight_class(eligible: Column) -> Column:
    return F.when(eligible == 0, F.lit("all_failed")).when(eligible == 1, F.lit("stable")).otherwise(F.lit("ambiguous"))


def class_weight(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CLASS_WEIGHTS.items() for x in pair]), name)


def valid_score(x: Column) -> Column:
    """A finite number between 0 and 1."""
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)
