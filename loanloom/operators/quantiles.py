"""Exact quantiles, plain or weighted, by distributed selection.

A value is mapped to a 64-bit number that orders like the value. Histograms over the upper bits
find the cell that holds a wanted rank, and the next histogram divides that cell by the bits below,
until a cell is a single value. Every round is one aggregate that combines map-side to at most
2 ** STEP cells for each wanted rank, whatever the rows, their skew or their order; values are
never ordered, sampled or collected, and nothing runs before the result is asked for.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 16  # bits that one round decides
ROUNDS = 64 // STEP

# Fixed values of the IEEE 754 double format.
FRACTION, BIAS, LOWEST, SPECIAL = 52, 1023, -1022, 2047


def ordered_bits(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add a BIGINT that orders like the DOUBLE column; -0.0 equals 0.0, NaN comes last.

    It is the magnitude's bit pattern with the value's sign. The exponent is guessed by a
    logarithm and put right by comparison; powers of two, and products with them, are exact.
    """
    size, power = f"abs(`{value}`)", f"pow(2D, `{name}`)"
    guess = f"greatest({LOWEST}, least({BIAS}, CAST(floor(log2({size})) AS INT)))"
    normal = f"{size} >= pow(2D, {LOWEST}) AND {size} < double('infinity')"
    corrected = (
        f"CASE WHEN NOT ({normal}) THEN 0 WHEN {size} < {power} THEN `{name}` - 1 "
        f"WHEN `{name}` < {BIAS} AND {size} >= 2D * {power} THEN `{name}` + 1 ELSE `{name}` END"
    )
    fraction = f"CAST(({size} / {power} - 1D) * pow(2D, {FRACTION}) AS BIGINT)"
    tiny = f"CAST({size} * pow(2D, 537) * pow(2D, 537) AS BIGINT)"
    magnitude = (
        f"CASE WHEN {normal} THEN shiftleft(CAST(`{name}` + {BIAS} AS BIGINT), {FRACTION}) + {fraction} "
        f"WHEN {size} < pow(2D, {LOWEST}) THEN {tiny} "
        f"WHEN isnan(`{value}`) THEN shiftleft({SPECIAL}L, {FRACTION}) + 1L "
        f"ELSE shiftleft({SPECIAL}L, {FRACTION}) END"
    )
    guessed = rows.withColumn(name, F.expr(f"CASE WHEN {normal} THEN {guess} ELSE 0 END"))
    exact = guessed.withColumn(name, F.expr(corrected)).withColumn(name, F.expr(magnitude))
    return exact.withColumn(name, F.expr(f"CASE WHEN `{value}` < 0D THEN -`{name}` ELSE `{name}` END"))


def exact_quantiles(
    df: DataFrame, series: str, value: str, probabilities: list[float], weight: str | None = None
) -> DataFrame:
    """(series, probability, value) with linear interpolation between ranks.

    ``series`` names a column with few distinct values, such as column names. ``weight`` names a
    column of whole numbers, how often each row counts; rows without a positive one don't.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    rows = df.select(F.col(series).alias("s"), F.col(value).cast("double").alias("v"), times.alias("w"))
    rows = rows.filter("v IS NOT NULL AND s IS NOT NULL AND w > 0")
    # A value has bits. Said openly, or each join below checks it, with all of the arithmetic copied into a filter.
    rows = ordered_bits(rows, "v", "bits").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    ranks = [f"r{i}" for i in range(2 * len(probabilities))]

    shift = STEP * (ROUNDS - 1)
    cells = rows.groupBy("s", F.shiftright("bits", shift).alias("cell")).agg(F.sum("w").alias("c"))
    cells = cells.withColumn("n", F.sum("c").over(Window.partitionBy("s")))
    for i, p in enumerate(probabilities):
        position = (F.col("n") - 1) * F.lit(float(p))
        cells = cells.withColumns({ranks[2 * i]: F.floor(position), ranks[2 * i + 1]: F.ceil(position)})
    wanted = _hit(cells.withColumn("v", F.lit(None).cast("double")), ["s"], ranks)

    while shift:
        # A row for each series and wanted rank at most; the next histogram is over their cells only.
        inside = F.broadcast(wanted.drop("v").withColumnsRenamed({"cell": "parent", "s": "of"}))
        here = (rows["s"] == inside["of"]) & (F.shiftright(rows["bits"], shift) == inside["parent"])
        shift -= STEP
        cells = (
            rows.join(inside, here)
            .groupBy("s", "parent", "n", *ranks, F.shiftright("bits", shift).alias("cell"))
            .agg(F.sum("w").alias("c"), F.min("v").alias("v"))
        )
        wanted = _hit(cells, ["s", "parent"], ranks)

    found = wanted.groupBy("s", "n").agg(
        *[F.max(F.when(F.col(r).isNotNull(), F.col("v"))).alias(r) for r in ranks]
    )
    points = []
    for i, p in enumerate(probabilities):
        low, high, position = F.col(ranks[2 * i]), F.col(ranks[2 * i + 1]), (F.col("n") - 1) * F.lit(float(p))
        between = F.when(low == high, low).otherwise(low + (high - low) * (position - F.floor(position)))
        points.append(F.struct(F.lit(float(p)).alias("probability"), between.alias("value")))
    return found.select(F.col("s").alias(series), F.explode(F.array(*points)).alias("q")).select(series, "q.*")


def _hit(cells: DataFrame, group: list[str], ranks: list[str]) -> DataFrame:
    """The cells that hold a wanted rank, with the ranks counted from the cell's first row."""
    before = F.sum("c").over(Window.partitionBy(*group).orderBy("cell")) - F.col("c")
    placed = cells.withColumn("before", before)
    inside = {r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("c")) for r in ranks}
    hit = placed.filter(reduce(or_, inside.values()))
    kept = [F.when(inside[r], F.col(r) - F.col("before")).alias(r) for r in ranks]
    return hit.select("s", "n", "cell", "v", *kept)


def describe(df: DataFrame, series: str, value: str, weight: str | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of ``value`` per series.

    With ``weight`` each row counts that often, as if it were repeated.
    """
    if weight is None:
        basics = df.groupBy(series).agg(
            F.count(value).alias("count"),
            F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("mean"),
            F.stddev_samp(F.col(value).cast("double")).alias("std"),
            F.min(value).cast("double").alias("min"),
            F.max(value).cast("double").alias("max"),
        )
    else:
        basics = _weighted(df, series, value, weight)
    quartile = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    points = exact_quantiles(df, series, value, list(quartile), weight)
    quartiles = points.groupBy(series).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for p, name in quartile.items()
        ]
    )
    return basics.join(quartiles, series, "left").select(
        series, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _weighted(df: DataFrame, series: str, value: str, weight: str) -> DataFrame:
    """count, mean, std, min and max; deviations are taken from the mean, which comes first."""
    v = F.col(value).cast("double")
    w = F.when(F.col(value).isNotNull(), F.greatest(F.col(weight).cast("long"), F.lit(0)))
    rows = df.select(F.col(series).alias("s"), v.alias("v"), F.coalesce(w, F.lit(0)).alias("w"))
    counted = F.when(F.col("w") > 0, F.col("v"))
    first = rows.groupBy("s").agg(
        F.sum("w").alias("count"), F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("mean"),
        F.min(counted).alias("min"), F.max(counted).alias("max"),
    )
    # One row for each series.
    center = F.broadcast(first.select(F.col("s").alias("of"), F.col("mean").alias("center")))
    apart = rows.join(center, F.col("s").eqNullSafe(F.col("of")))
    square = F.col("w") * F.pow(F.col("v") - F.col("center"), F.lit(2.0))
    spread = apart.groupBy("s").agg(F.sqrt(F.try_divide(F.sum(square), F.sum("w") - 1)).alias("std"))
    spread = spread.withColumnRenamed("s", "of")
    joined = first.join(spread, F.col("s").eqNullSafe(F.col("of")))
    std = F.when(F.col("count") > 1, F.col("std")).alias("std")
    return joined.select(F.col("s").alias(series), "count", "mean", std, "min", "max")


def describe_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``describe`` for several numeric columns at once, one row per column."""
    typed = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    return describe(typed.unpivot([], names, "column", "value"), "column", "value")


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    typed = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    long = typed.unpivot([], names, "column", "value")
    points = exact_quantiles(long, "column", "value", [0.5])
    return points.agg(
        *[F.max(F.when(F.col("column") == n, F.col("value"))).alias(n) for n in names]
    )
