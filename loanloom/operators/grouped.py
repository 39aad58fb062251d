"""One grouped aggregate per table, with exact most-frequent labels.

A most-frequent label is found by counting each label of the column's declared
domain: fixed-width counters keep the aggregate in generated code, where the
built-in ``mode`` needs an object map per group. A label outside the domain makes
its row appear once more, tagged with the column and the label. One aggregate by key
and tag then holds the group itself, without a tag, and the count of each stray label
beside it, all combined map-side; the next one puts a key's tags together. The table
is read once, and a hot key or a column with very many labels never gathers in one task.
Ties go to the smallest label.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggregates import measure, quoted
from loanloom.schemas import LABELS, UNKNOWN

_KNOWN = "__known_"
_RARE = "__rare_"
_STRAY = "__stray_"
_AT, _TAG, _LABEL, _N = "__at", "__tag", "__label", "__n"


def _known_best(name: str, labels: list[str]) -> str:
    """(-count, label) of the most frequent declared label, NULL if none occurs."""
    candidates = ["CAST(NULL AS STRUCT<n: BIGINT, label: STRING>)"] * 2
    for label in sorted(labels):
        text = quoted(label)
        n = f"count_if(`{name}` = {text})"
        candidates.append(
            f"CASE WHEN {n} > 0 THEN named_struct('n', -{n}, 'label', {text}) END"
        )
    return f"least({', '.join(candidates)})"


def _strays(name: str, labels: list[str]) -> str:
    """How many values lie outside the declared labels."""
    listed = ", ".join(quoted(label) for label in labels)
    outside = f"AND `{name}` NOT IN ({listed})" if listed else ""
    return f"count_if(`{name}` IS NOT NULL {outside})"


def _outside(name: str, labels: list[str]) -> Column:
    known = F.col(name).isin(labels) if labels else F.lit(False)
    return F.col(name).isNotNull() & ~known


def _tagged(rows: DataFrame, names: list[str], labels: dict[str, list[str]]) -> DataFrame:
    """Every row without a tag, and once more for each of its labels outside the domain."""
    kind = "struct<name: string, label: string>"
    stray = {name: _outside(name, labels.get(name, [])) for name in names}
    tags = [F.when(is_stray, F.struct(F.lit(name).alias("name"), F.col(name).alias("label"))) for name, is_stray in stray.items()]
    none = F.lit(None).cast(kind)
    # Rows without a stray label, nearly all of them, make no more than an array of one.
    tag = F.when(reduce(or_, stray.values()), F.array(none, *tags)).otherwise(F.array(none))
    marked = rows.select("*", F.posexplode(tag).alias(_AT, _TAG))
    kept = marked.filter((F.col(_AT) == 0) | F.col(_TAG).isNotNull()).drop(_AT)
    return kept.withColumns({_TAG: F.col(f"{_TAG}.name"), _LABEL: F.col(f"{_TAG}.label")})


def _with_strays(
    rows: DataFrame, keys: list[str], columns: list[Column], names: list[str], labels: dict[str, list[str]]
) -> DataFrame:
    """The columns by key, and the most frequent stray label of each name."""
    counted = _tagged(rows, names, labels).groupBy(*keys, _TAG, _LABEL).agg(*columns, F.count(F.lit(1)).alias(_N))
    own = [c for c in counted.columns if c not in (*keys, _TAG, _LABEL, _N)]
    best = [
        F.min(F.when(F.col(_TAG) == name, F.struct((-F.col(_N)).alias("n"), F.col(_LABEL).alias("label")))).alias(
            _RARE + name
        )
        for name in names
    ]
    group = [F.max(F.when(F.col(_TAG).isNull(), F.col(f"`{c}`"))).alias(c) for c in own]
    return counted.groupBy(*keys).agg(*group, *best)


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose group key is complete; a NULL key forms no group."""
    return df.filter(reduce(and_, [F.col(key).isNotNull() for key in keys]))


def grouped(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, str],
    modes: dict[str, str] | None = None,
    labels: dict[str, list[str]] | None = None,
    closed_labels: bool = False,
) -> DataFrame:
    """Aggregate ``df`` by ``keys``.

    ``measures`` maps result names to SQL aggregates, ``modes`` maps result names
    to label columns. ``closed_labels=True`` does without tags for labels outside
    the declared domains; one aggregate counts them, and the query fails if there
    is one.
    """
    modes = modes or {}
    labels = LABELS if labels is None else labels
    names = list(dict.fromkeys(modes.values()))
    rows = with_keys(df, keys)
    best = {_KNOWN + name: _known_best(name, labels.get(name, [])) for name in names}
    if closed_labels:
        best |= {_STRAY + name: _strays(name, labels.get(name, [])) for name in names}
    columns = [measure(sql, alias) for alias, sql in {**measures, **best}.items()]
    if not names:
        return rows.groupBy(*keys).agg(*columns)

    known = {name: f"`{_KNOWN}{name}`" for name in names}
    if closed_labels:
        out = rows.groupBy(*keys).agg(*columns)
    else:
        out = _with_strays(rows, keys, columns, names, labels)
        known = {name: f"least({sql}, `{_RARE}{name}`)" for name, sql in known.items()}
    labelled = {n: f"coalesce({sql}.label, {quoted(UNKNOWN)})" for n, sql in known.items()}
    if closed_labels:
        labelled = {
            n: f"CASE WHEN `{_STRAY}{n}` = 0 THEN {sql} ELSE "
            f"raise_error({quoted(f'{n} has a label outside its domain')}) END"
            for n, sql in labelled.items()
        }
    winners = [measure(labelled[name], alias) for alias, name in modes.items()]
    return out.select(*keys, *[f"`{name}`" for name in measures], *winners)
