"""Fitted numbers of the rule and of the linear model, stored and read back bit by bit.

Scoring has to use the medians, means and weights of its training, in whatever session
it runs. They are a few hundred named numbers, kept as one small table (kind, name, value);
values that could not be fitted are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanloom.operators.explanations import baseline_means
from loanloom.operators.risk import filled_inputs, rule_medians, with_rule_terms
from loanloom.plans.scoring import Scorer, rule_scorer
from loanloom.plans.training import LinearModel
from loanloom.schemas import RULE_WEIGHTS

Numbers = dict[str, dict[str, float]]

_SCHEMA = "kind string, pos int, name string, value double"


def write_numbers(spark: SparkSession, numbers: Numbers, path: str) -> None:
    rows = [
        (kind, i, name, None if value is None else float(value))
        for kind, named in numbers.items()
        for i, (name, value) in enumerate(named.items())
    ]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read_numbers(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> Numbers:
    """The numbers of the given kinds, in their stored order; an unknown kind fails."""
    rows = spark.read.schema(_SCHEMA).parquet(path).orderBy("kind", "pos").collect()
    found: Numbers = {kind: {r["name"]: r["value"] for r in rows if r["kind"] == kind} for kind in kinds}
    missing = [kind for kind, named in found.items() if not named]
    if missing:
        raise ValueError(f"{path} holds no {', '.join(missing)}")
    return found


def write_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    own = {"weight": model.weights, "mean": model.means, "intercept": {"intercept": model.intercept}}
    write_numbers(spark, own, path)


def read_linear(spark: SparkSession, path: str) -> LinearModel:
    own = read_numbers(spark, path, ("weight", "mean", "intercept"))
    return LinearModel(own["weight"], own["mean"], own["intercept"]["intercept"])


def fit_rule(profile: DataFrame) -> Numbers:
    """Medians and mean terms of the rule over a training table."""
    filled = filled_inputs(profile)
    middle = rule_medians(filled)
    return {"median": middle, "mean": baseline_means(with_rule_terms(filled, middle), list(RULE_WEIGHTS))}


def write_rule(spark: SparkSession, fitted: Numbers, path: str) -> None:
    write_numbers(spark, fitted, path)


def read_rule(spark: SparkSession, path: str) -> Scorer:
    """Scorer of the rule with the stored medians and means."""
    own = read_numbers(spark, path, ("median", "mean"))
    return rule_scorer(own["median"], own["mean"])
