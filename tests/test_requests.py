"""Scoring requests: edge cases, streaming against batch, stored metadata."""

import json

import pytest
from compare import differences, spark_table
from pyspark.sql import functions as F

from loanloom.operators import quality, risk
from loanloom.operators.alignment import FeatureSchema, schema_of
from loanloom.operators.explanations import baseline_means
from loanloom.plans import scoring, training
from loanloom.plans.wide import wide_features
from loanloom.queries import requests as request_queries
from loanloom.queries.requests import QUERIES
from loanloom.schemas import CHILD_TABLES, RULE_WEIGHTS
from loanloom.sources import payload, tables
from loanloom.sources.adapters import lending_tables
from loanloom.sources.request_views import requests
from loanloom.streaming import requests as streaming

pytestmark = pytest.mark.usefixtures("interpreted")


def profile(customer=7, **more):
    return {"CUSTOMER_ID": customer, "LOAN_AMOUNT": 1000.0, **more}


def parse(spark, bodies):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bodies.items()]
    return payload.parse(spark.createDataFrame(rows, "REQUEST_ID string, body string"))


def test_child_rows_of_texts_are_those_of_typed_arrays(spark):
    rows = [{"CUSTOMER_ID": "7", "DAYS_SINCE_DECISION": d, "LOAN_AMOUNT": a, "CLIENT_TYPE": c, "PRIOR_LOAN_ID": i}
            for d, a, c, i in ((-3.0, "1e3", "x", 1.5), ("-9", "NaN", None, " 4 "), ("junk", None, 5, 3.0))]
    bodies = {
        "dirty": {"customer_profile": profile(), "prior_loan_history": rows, "cash_pos_records": [{}]},
        "empty": {"customer_profile": profile(), "prior_loan_history": [], "card_activity": None},
        "odd": {"customer_profile": profile(), "prior_loan_history": [None, {}], "credit_timeline": [{"ACCOUNT_STATUS": 1}]},
        "rejected": {"prior_loan_history": rows},
    }
    sent = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "REQUEST_ID string, body string")
    typed = payload.accepted(payload.parse(sent))
    texts = payload.accepted(payload.parse(sent, typed=False))
    for table in CHILD_TABLES:
        was, now = payload.child_rows(typed, table), payload.child_rows(texts, table)
        assert was.dtypes == now.dtypes
        assert sorted(map(repr, was.collect())) == sorted(map(repr, now.collect()))
    found = payload.child_rows(texts, "prior_loan_history").filter("REQUEST_ID = 'dirty'").collect()
    assert {(r["__decision_low"], r["__decision_high"]) for r in found} == {(-9, -3)}


def test_staged_requests_keep_their_texts(spark, sf):
    """Values get their types where a table is read, in generated code, and no profile is stored for child rows."""
    staged = request_queries._staged(spark, sf)
    assert "customer_profile" not in staged.columns
    kinds = {f.dataType.typeName() for t in CHILD_TABLES for f in staged.schema[t].dataType.elementType}
    assert kinds == {"string"}


def test_rejects(spark):
    parsed = parse(
        spark,
        {
            "good": {"customer_profile": profile()},
            "cut": '{"customer_profile": ',
            "no profile": {"credit_summary": []},
            "no id": {"customer_profile": {"LOAN_AMOUNT": 1.0}},
            "bad id": {"customer_profile": profile("x")},
        },
    )
    got = {r[0]: r[1] for r in payload.rejects(parsed).collect()}
    assert set(got) == {"cut", "no profile", "no id", "bad id"}
    assert got["no id"] == "no CUSTOMER_ID"


def test_dirty_values_are_coerced(spark):
    """Numbers as text, whole numbers with a fraction point, junk and quoted ids all score."""
    installment = {"PRIOR_LOAN_ID": "3", "DAYS_UNTIL_DUE": -3.0, "SCHEDULED_PAYMENT_AMOUNT": "12x",
                   "ACTUAL_PAYMENT_AMOUNT": "4.5"}
    bodies = {
        "int": {"customer_profile": profile(7, NUM_CHILDREN=2.0, MONTHLY_INCOME="4000")},
        "float": {"customer_profile": profile(7.0), "installment_records": [{"CUSTOMER_ID": 7.0, **installment}]},
        "text": {"customer_profile": profile("7"), "installment_records": [{"CUSTOMER_ID": "7", **installment}]},
        "half": {"customer_profile": profile(1.5)},
        "word": {"customer_profile": profile("abc")},
        "rounded": {"customer_profile": profile(8, NUM_CHILDREN="2.5", LOAN_ANNUITY="junk", GENDER_CODE=1)},
    }
    parsed = parse(spark, bodies)
    reasons = {r[0]: r[1] for r in payload.rejects(parsed).collect()}
    assert reasons == {"half": "CUSTOMER_ID is no whole number", "word": "CUSTOMER_ID is no number"}
    rows = {r["REQUEST_ID"]: r for r in payload.profile_rows(payload.accepted(parsed)).collect()}
    assert rows["int"]["NUM_CHILDREN"] == 2 and rows["int"]["MONTHLY_INCOME"] == 4000.0
    assert rows["rounded"]["NUM_CHILDREN"] == 2 and rows["rounded"]["LOAN_ANNUITY"] is None
    assert rows["rounded"]["GENDER_CODE"] == "1"
    wide = {r["REQUEST_ID"]: r for r in scoring.payload_features(parsed).collect()}
    assert set(wide) == {"int", "float", "text", "rounded"}
    for name in ("float", "text"):
        assert wide[name]["CUSTOMER_ID"] == 7
        assert wide[name]["installments_NUM_PAYMENTS"] == 1
    assert wide["int"]["installments_NUM_PAYMENTS"] is None


def test_equal_request_ids_stay_apart(spark):
    """Requests that share an id, even a whole body, are scored one by one; no id is refused."""
    def body(customer):
        row = {"CUSTOMER_ID": customer, "PRIOR_LOAN_ID": 1, "SCHEDULED_PAYMENT_AMOUNT": 2.0,
               "ACTUAL_PAYMENT_AMOUNT": 2.0}
        return json.dumps({"customer_profile": profile(customer), "installment_records": [row]})

    rows = [("same", body(7)), ("same", body(7)), ("same", body(8)), (None, body(7))]
    parsed = payload.parse(spark.createDataFrame(rows, "REQUEST_ID string, body string"))
    wide = scoring.payload_features(parsed).collect()
    assert sorted((r["REQUEST_ID"], r["CUSTOMER_ID"]) for r in wide) == [("same", 7), ("same", 7), ("same", 8)]
    assert {r["installments_NUM_PAYMENTS"] for r in wide} == {1}
    assert [tuple(r) for r in payload.rejects(parsed).collect()] == [(None, "no REQUEST_ID")]


def test_missing_and_empty_blocks_and_shared_customers(spark):
    card = {"CUSTOMER_ID": 7, "PRIOR_LOAN_ID": 1, "CURRENT_CARD_BALANCE": 4.0}
    prior = [{"CUSTOMER_ID": 7, "PRIOR_LOAN_ID": i, "DAYS_SINCE_DECISION": -i} for i in (1, 2)]
    parsed = parse(
        spark,
        {
            "a": {"customer_profile": profile(), "card_activity": [card]},
            "b": {"customer_profile": profile(), "card_activity": [], "prior_loan_history": prior},
            "c": {"customer_profile": profile(8), "card_activity": [card]},
        },
    )
    wide = {r["REQUEST_ID"]: r for r in scoring.payload_features(parsed).collect()}
    assert len(wide) == 3
    # 482 features without the duplicated installment columns (458), and two keys
    assert len(wide["a"]) == 460
    assert wide["a"]["card_activity_TOTAL_CREDIT_BALANCE"] == 4.0
    assert wide["b"]["card_activity_TOTAL_CREDIT_BALANCE"] is None
    assert wide["c"]["card_activity_TOTAL_CREDIT_BALANCE"] is None  # rows of someone else
    assert wide["b"]["prior_loan_agg_DAYS_SINCE_DECISION_BIN_max"] == 19
    assert wide["a"]["prior_loan_NUM_APPLICATIONS"] is None


def test_request_path_equals_table_path(spark, sf):
    parsed = payload.stage(payload.parse(requests(spark, sf)))
    accepted = payload.accepted(parsed)
    by_request = payload.payload_tables(accepted)
    wide = scoring.payload_features(parsed)
    assert wide.count() == accepted.count()
    # The same rows as plain tables, every request being a customer of its own.
    as_tables = {}
    for name, df in by_request.items():
        if "CUSTOMER_ID" in df.columns:
            df = df.withColumn("CUSTOMER_ID", F.col("REQUEST_ID").cast("bigint"))
        as_tables[name] = df.drop("REQUEST_ID", payload.ROW)
    foreign = by_request["credit_summary"].filter("CUSTOMER_ID >= 1000000")
    as_tables["credit_summary"] = (
        by_request["credit_summary"]
        .join(foreign.select("REQUEST_ID", "CREDIT_RECORD_ID"), ["REQUEST_ID", "CREDIT_RECORD_ID"], "left_anti")
        .withColumn("CUSTOMER_ID", F.col("REQUEST_ID").cast("bigint"))
        .drop("REQUEST_ID", payload.ROW)
    )
    plain = wide_features(as_tables)
    loose = [c for c in plain.columns if "_STD_" in c]
    left = wide.withColumn("CUSTOMER_ID", F.col("REQUEST_ID").cast("bigint"))
    left = left.drop("REQUEST_ID", *loose)
    assert differences(spark_table(left), spark_table(plain.drop(*loose))) == []


@pytest.fixture(scope="module")
def scorer(spark, sf):
    filled = risk.filled_inputs(lending_tables(spark, sf)["customer_profile"])
    middle = risk.rule_medians(filled)
    terms = risk.with_rule_terms(filled, middle)
    return scoring.rule_scorer(middle, baseline_means(terms, list(RULE_WEIGHTS)))


def test_stream_equals_batch(spark, sf, scorer, tmp_path):
    source = requests(spark, sf)
    source.repartition(2).write.json(str(tmp_path / "in"))
    stream = streaming.request_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    query = streaming.start_scoring(
        stream, scorer, str(tmp_path / "out"), str(tmp_path / "checkpoint")
    )
    query.awaitTermination(600)
    assert query.exception() is None
    batch, refused = streaming.score_batch(payload.parse(source), scorer)
    got = streaming.read_predictions(spark, str(tmp_path / "out"))
    assert differences(spark_table(got), spark_table(batch)) == []
    got = streaming.read_rejects(spark, str(tmp_path / "out"))
    assert differences(spark_table(got), spark_table(refused)) == []
    record = json.loads(batch.first()["record"])
    assert set(record) == {"prediction", "probability", "formatted_probability", "explanations"}
    assert len(record["explanations"]) == 3


def test_feature_schema_round_trip(spark, sf, tmp_path):
    df = lending_tables(spark, sf)["customer_profile"]
    schema = schema_of(df, exclude=("TARGET",))
    assert schema.dtypes["OCCUPATION_TYPE"] == "category"
    assert schema.categories["OCCUPATION_TYPE"] == [f"Job {x}" for x in "ABCDE"]
    tables.write_feature_schema(spark, schema, str(tmp_path / "schema"))
    assert tables.read_feature_schema(spark, str(tmp_path / "schema")) == schema
    document = {
        "features": schema.features,
        "dtypes": schema.dtypes,
        "category_mappings": schema.categories,
    }
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(document, indent=2))
    assert tables.read_feature_document(spark, str(path)) == schema


def test_column_profile_round_trip(spark, sf, tmp_path):
    df = lending_tables(spark, sf)["credit_summary"]
    profile_ = quality.column_profile(df, "credit_summary")
    tables.write_column_profile(profile_, str(tmp_path / "profile"))
    back = tables.read_column_profile(spark, str(tmp_path / "profile"))
    assert differences(spark_table(back), spark_table(profile_)) == []
    names = tables.category_columns(back, "credit_summary")
    assert sorted(names) == [
        "CREDIT_STATUS", "CURRENCY_TYPE", "NUM_CREDIT_EXTENSIONS", "TYPE_OF_CREDIT"
    ]
    forced = tables.force_categories(df.selectExpr("1 AS CREDIT_STATUS"), names)
    assert forced.schema["CREDIT_STATUS"].dataType.typeName() == "string"


def test_declared_schema_on_read(spark, sf, tmp_path):
    df = lending_tables(spark, sf)["credit_timeline"]
    df.write.parquet(str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), "credit_timeline")
    assert differences(spark_table(back), spark_table(df)) == []


def test_model_round_trip(spark, sf, tmp_path):
    t = lending_tables(spark, sf, names=["customer_profile", "credit_summary"])
    data = training.training_set(wide_features(t, keep_target=True))
    model = training.train_boosted(data, trees=2, depth=2)
    tables.write_model(model, str(tmp_path / "model"))
    again = tables.read_model(str(tmp_path / "model"))
    scored = training.score(again, data.rows).select("CUSTOMER_ID", "probability_of_default")
    first = training.score(model, data.rows).select("CUSTOMER_ID", "probability_of_default")
    assert differences(spark_table(scored), spark_table(first)) == []
    schema = FeatureSchema(
        [*data.numbers, *data.texts],
        {**{n: "float64" for n in data.numbers}, **{n: "category" for n in data.texts}},
    )
    wide = wide_features(t).withColumn("REQUEST_ID", F.col("CUSTOMER_ID").cast("string"))
    rows = scoring.prediction_rows(scoring.model_scorer(again, schema)(wide))
    probabilities = {r[0]: r[1] for r in first.collect()}
    for r in rows.collect():
        assert r["default_probability"] == pytest.approx(probabilities[r["CUSTOMER_ID"]])
        assert 1 <= len(r["explanations"]) <= 3


def test_each_body_is_parsed_once(spark, sf):
    """No condition holds a copy of the parser, and the bodies are made in many tasks."""
    for name in ("payload_profile", "payload_rejects", "scenario_override"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan()
        assert plan.toString().count("from_json(") == 1, name
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert requests(spark, sf).select(F.spark_partition_id()).distinct().count() == tasks
