"""The language model's shares for rare and unseen tokens, on both sides of FREQUENT."""

import pytest
from pyspark.sql import functions as F

from loanloom.llm import lm


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 4, 0])
def test_shares_do_not_depend_on_frequent(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    held = [*range(20, 30), *[2] * 6, *[1] * 40]
    counts = spark.createDataFrame(list(enumerate(held)), "token long, n long")
    words = lm.vocabulary(counts)
    last = words.mass()[-1]
    assert words.unseen * last == pytest.approx(0.9 * 40)
    rest = counts.filter(~F.col("token").isin([int(x) for x in words.hashes.view("int64")]))
    shares = [(r["n"], r["share"]) for r in rest.select("n", words.seen(F.col("n")).alias("share")).collect()]
    assert all(x * last == pytest.approx(n if n > 1 else 0.1) for n, x in shares)
    assert sum(x for _, x in shares) + words.unseen == pytest.approx(1.0)
