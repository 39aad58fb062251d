"""The secret scan's training sample on skewed classes."""

from loanloom.llm import secrets


def test_rare_class_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(secrets, "LABELLED", 20)
    rows = [(i, f"the card {4000000000000000 + i * 7919} was used", "a") for i in range(600)]
    rows += [(1000 + i, f'text with token = "AKIA{i:016X}" and more', "a") for i in range(3000, 3003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in secrets.scan(df).collect()}
    assert all(got[k] == (k >= 1000) for k, _, _ in rows)
