"""Quality, coverage and column-profile reports. Each is one aggregate over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggregates import mean, measure, quoted
from loanloom.operators.alignment import DTYPE_NAMES
from loanloom.schemas import CUSTOMER, RANGE_OVERRIDES, is_number


def _tall(row: DataFrame, entries: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def quality_report(df: DataFrame, table: str) -> DataFrame:
    """(table, column, n_rows, n_null, n_hidden, n_inf) for every column.

    Hidden values are the texts '' and 'nan'; infinities are counted apart from NULLs.
    """
    checks, entries = {"__rows": "count(1)"}, []
    for i, f in enumerate(df.schema):
        kind, x = f.dataType.typeName(), f"`{f.name}`"
        floating = kind in ("double", "float")
        present = f"nanvl({x}, NULL)" if floating else x
        checks[f"set_{i}"] = f"count({present})"
        hidden = infinite = "0L"
        if kind == "string":
            hidden = f"hidden_{i}"
            checks[hidden] = f"count_if({x} IN ('', 'nan'))"
        if floating:
            infinite = f"inf_{i}"
            checks[infinite] = f"count_if(abs({x}) = double('infinity'))"
        entries.append(
            f"named_struct('table', {quoted(table)}, 'column', {quoted(f.name)}, "
            f"'n_rows', __rows, 'n_null', __rows - set_{i}, "
            f"'n_hidden', {hidden}, 'n_inf', {infinite})"
        )
    row = df.agg(*[measure(sql, name) for name, sql in checks.items()])
    return row.select(F.expr(f"inline(array({', '.join(entries)}))"))


def block_coverage(stages: dict[str, DataFrame], key: str = CUSTOMER) -> DataFrame:
    """(stage, n_rows, n_customers, n_columns) of each named table."""
    out = None
    for name, df in stages.items():
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_customers")
        ).select(F.lit(name).alias("stage"), "*", F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """(table, column, dtype, min, max, mean, std, categories) for every column with a type here.

    One aggregate, so a table that comes from a join is joined once. Labels are made distinct
    map-side; only the vocabulary of a column, which the report shows, is ever in one place.
    """
    none = F.lit(None)
    empty = {s: none.cast("double") for s in ("min", "max", "mean", "std")}
    stats, entries = [], []
    for i, f in enumerate(df.schema):
        if is_number(f.dataType):
            stats += [
                F.min(f.name).cast("double").alias(f"min_{i}"),
                F.max(f.name).cast("double").alias(f"max_{i}"),
                F.expr(mean(f"`{f.name}`")).alias(f"mean_{i}"),
                F.stddev_samp(F.col(f.name).cast("double")).alias(f"std_{i}"),
            ]
            dtype = DTYPE_NAMES.get(f.dataType.simpleString(), "float64")
            found = {s: F.col(f"{s}_{i}") for s in empty}
            categories = none.cast("array<string>")
        elif f.dataType.typeName() == "string":
            stats.append(F.array_sort(F.collect_set(f.name)).alias(f"categories_{i}"))
            dtype, found, categories = "category", empty, F.col(f"categories_{i}")
        else:
            continue
        entries.append(
            F.struct(
                F.lit(table).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(dtype).alias("dtype"),
                *[column.alias(s) for s, column in found.items()],
                categories.alias("categories"),
            )
        )
    # A text column without any label has no row.
    return _tall(df.agg(*stats), entries).filter("categories IS NULL OR size(categories) > 0")


def with_overrides(profile: DataFrame, overrides=None) -> DataFrame:
    """Replace min, max, mean and std of the columns that have a plausible range."""
    overrides = RANGE_OVERRIDES if overrides is None else overrides
    values = ", ".join(
        f"('{name}', {', '.join(f'{float(v)}D' for v in stats)})"
        for name, stats in overrides.items()
    )
    fixed = profile.sparkSession.sql(
        f"SELECT * FROM VALUES {values} AS o(`column`, o_min, o_max, o_mean, o_std)"
    )
    stats = ("min", "max", "mean", "std")
    joined = profile.join(fixed, "column", "left")
    patched = {s: F.coalesce(F.col(f"o_{s}"), F.col(s)) for s in stats}
    return joined.withColumns(patched).select(*profile.columns)


def value_counts(df: DataFrame, name: str, top: int = 5) -> DataFrame:
    """The most frequent values, NULL included; ties go to the smaller value."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.col(name).asc_nulls_last()).limit(top)
