"""Sums that don't depend on how values are grouped: each addition's rounding error is kept and added at the end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def compensated_sum(values: Column) -> Column:
    """The sum of an array of doubles, in its order, with the errors of all additions; 0 for an empty one."""

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        back = total - state["total"]
        lost = (state["total"] - (total - back)) + (x - back)
        return F.struct(total.alias("total"), (state["lost"] + lost).alias("lost"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    return F.aggregate(values, start, add, lambda s: s["total"] + s["lost"])


def compensated_rows(values: np.ndarray) -> np.ndarray:
    """The same of each row of a matrix."""
    total, lost = np.zeros(len(values)), np.zeros(len(values))
    for x in values.T:
        grown = total + x
        back = grown - total
        lost += (total - (grown - back)) + (x - back)
        total = grown
    return total + lost
