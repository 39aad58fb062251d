"""Label tables of any size, early stopping, repeated requests in a stream."""

import json

import pytest
from pyspark.sql import functions as F

from loanloom.operators import alignment
from loanloom.operators.alignment import FeatureSchema
from loanloom.plans import training
from loanloom.streaming import requests as streaming


@pytest.fixture(scope="module")
def many(spark):
    """A hundred thousand labels, one of which holds half of the rows; nulls and a small column."""
    return spark.range(200_000).selectExpr(
        "id", "CASE WHEN id % 2 = 0 THEN 'label 7' WHEN id % 997 = 0 THEN NULL "
        "ELSE concat('label ', id) END AS wide", "substr('abc', CAST(id % 3 AS INT) + 1, 1) AS narrow",
    )


def test_codes_are_dense_and_ordered(many):
    codes = alignment.label_codes(many, ["wide", "narrow"]).collect()
    for name in ("wide", "narrow"):
        labels = sorted({r[name] for r in many.select(name).distinct().collect()} - {None})
        assert {r["label"]: r["code"] for r in codes if r["feature"] == name} == {x: i for i, x in enumerate(labels)}


def test_domain_check_by_table(spark, many):
    codes = alignment.label_codes(many.filter("id % 5 > 0"), ["wide", "narrow"])
    schema = FeatureSchema(["wide", "narrow"], {"wide": "category", "narrow": "category"})
    rows = many.unionByName(spark.createDataFrame([(-1, "label 3", "z")], "id long, wide string, narrow string"))
    typed = alignment.enforce_types(rows, schema, codes)
    assert typed.columns == rows.columns
    known = {r["label"] for r in codes.filter("feature = 'wide'").collect()}
    before = {r["id"]: r for r in rows.collect()}
    got = typed.collect()
    assert len(got) == len(before)
    for r in got:
        was = before[r["id"]]
        assert r["wide"] == (was["wide"] if was["wide"] in known else None)
        assert r["narrow"] == (was["narrow"] if was["narrow"] in ("a", "b", "c") else None)


def test_table_and_lists_agree(many):
    few = many.filter("id < 50")
    lists = alignment.schema_of(few, exclude=("id",))
    bare = alignment.schema_of(few, exclude=("id",), domains_as_lists=False)
    assert lists.categories and not bare.categories
    codes = alignment.label_codes(few, ["wide", "narrow"])
    rows = many.filter("id < 90")
    left, right = alignment.enforce_types(rows, lists), alignment.enforce_types(rows, bare, codes)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


@pytest.mark.parametrize("losses, patience, want", [
    ([3.0, 2.0, 1.0], 2, (3, False)), ([3.0, 1.0, 2.0], 2, (2, False)), ([3.0, 1.0, 2.0, 2.0, 0.5], 2, (2, True)),
    ([1.0], 1, (1, False)), ([1.0, 1.0], 1, (1, True)), ([2.0, 3.0, 1.0, 4.0, 4.0], 2, (3, True)),
])
def test_best_size(losses, patience, want):
    assert training.best_size(losses, patience) == want


def test_later_trees_that_hurt_are_cut(spark):
    """Labels are mostly noise, so each further tree fits the training rows and harms the others."""
    rows = spark.range(600).selectExpr(
        "CAST(xxhash64(id, 1) % 1000 AS DOUBLE) AS a", "CAST(xxhash64(id, 2) % 1000 AS DOUBLE) AS b",
        "substr('abcdefgh', CAST(id % 8 AS INT) + 1, 1) AS kind",
        "CAST(IF(pmod(xxhash64(id, 3), 4) = 0, id % 8 < 4, pmod(xxhash64(id, 4), 2) = 0) AS BIGINT) AS TARGET",
        "IF(id % 4 = 0, 'validation', 'train') AS split", "1D AS weight",
    ).cache()
    data = training.TrainingSet(rows, ["a", "b"], ["kind"])
    model = training.train_boosted(data, trees=24, rate=0.5, patience=4, min_rows=1)
    longest = training.train_boosted(data, trees=24, rate=0.5, patience=24, min_rows=1)
    kept = model.stages[-1].getNumTrees
    held = model.stages[-2].transform(model.stages[0].transform(rows.filter("split = 'validation'")))
    losses = model.stages[-1].evaluateEachIteration(held)
    assert kept < 24 and losses[-1] == min(losses)
    # The model with all the patience ends at the lowest loss of all 24 trees; it begins with the same ones.
    assert longest.stages[-1].evaluateEachIteration(held)[:kept] == pytest.approx(losses)


def arrivals(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"REQUEST_ID": k, "body": b, "arrived": t}) for k, b, t in rows]
    (folder / name).write_text("\n".join(lines))


def test_repeats_inside_across_and_after_restart(spark, tmp_path):
    folder, out, seen = tmp_path / "in", str(tmp_path / "out"), []

    def run():
        stream = streaming.request_stream(spark, str(folder), files_per_batch=1, with_arrival=True)
        query = (
            streaming.without_repeats(stream, "1 hour").writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(out)
        )
        query.awaitTermination(300)
        assert query.exception() is None
        seen[:] = sorted((r["REQUEST_ID"], r["body"]) for r in spark.read.parquet(out).collect())

    day = "2024-05-01T"
    arrivals(folder, "1.json", [("a", "x", day + "10:00:00Z"), ("a", "x", day + "10:00:05Z"), ("a", "y", day + "10:00:06Z")])
    arrivals(folder, "2.json", [("a", "x", day + "10:20:00Z"), ("b", "x", day + "10:20:00Z")])
    run()
    assert seen == [("a", "x"), ("a", "y"), ("b", "x")]
    arrivals(folder, "3.json", [("a", "x", day + "10:40:00Z"), ("c", "x", day + "10:40:00Z"), ("b", "x", day + "10:41:00Z")])
    run()
    assert seen == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]
    # Long after the first, when its state is gone, the same request counts as a new one.
    arrivals(folder, "4.json", [("d", "x", day + "15:00:00Z")])
    run()
    arrivals(folder, "5.json", [("a", "x", day + "15:10:00Z")])
    run()
    assert seen == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("d", "x")]


def test_null_ids_are_kept_apart_by_body(spark, tmp_path):
    arrivals(tmp_path / "in", "1.json", [(None, "x", "2024-05-01T10:00:00Z"), (None, "z", "2024-05-01T10:00:00Z")])
    stream = streaming.request_stream(spark, str(tmp_path / "in"), with_arrival=True)
    query = (
        streaming.without_repeats(stream, "1 hour").writeStream.format("memory").queryName("kept")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    assert spark.table("kept").filter(F.col("REQUEST_ID").isNull()).count() == 2
