"""Fixed-edge and equal-width bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom.schemas import LABELS

N_BINS = 20
LOAN_AGE_EDGES = [-100, -48, -24, 0]


def loan_age_group(age: Column) -> Column:
    """Right-closed age tiers over months before today; NULL outside all of them."""
    tier = None
    lows, highs = LOAN_AGE_EDGES[:-1], LOAN_AGE_EDGES[1:]
    for low, high, label in zip(lows, highs, LABELS["LOAN_AGE_GROUP"]):
        inside = (age > low) & (age <= high)
        tier = F.when(inside, label) if tier is None else tier.when(inside, label)
    return tier


def equal_width_bin(value: Column, low: Column, high: Column, integral: bool = True) -> Column:
    """Bin 0..19 of a value in the observed range, right-closed, lowest value in bin 0.

    A range of one value puts it in the middle bin. Whole numbers use exact
    integer division, so values on an edge never slip into the next bin.
    """
    width = F.nullif(high - low, F.lit(0))
    if integral:
        upper = F.call_function("div", F.lit(N_BINS) * (value - low) + width - 1, width)
    else:
        upper = F.ceil((value - low).cast("double") / (width.cast("double") / N_BINS))
    inside = F.greatest(F.lit(0), F.least(F.lit(N_BINS - 1), upper - 1)).cast("bigint")
    single = F.when(value.isNotNull(), F.lit(N_BINS // 2 - 1).cast("bigint"))
    return F.when(high == low, single).when(value.isNotNull(), inside)

