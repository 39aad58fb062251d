"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table directory, BENCH_CPUS the local threads. Money is
DOUBLE here, as in production; every result is computed in full and discarded. The
JSON of the requests is made before the clock starts. Queries under SHORT seconds run
three times and count with the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loanloom.operators import labels, quality, risk  # noqa: E402
from loanloom.operators.blocks import card_activity, credit_timeline  # noqa: E402
from loanloom.plans.scoring import payload_features, rule_explanations  # noqa: E402
from loanloom.plans.wide import feature_blocks, wide_features  # noqa: E402
from loanloom.session import local_session  # noqa: E402
from loanloom.sources import payload  # noqa: E402
from loanloom.sources.adapters import lending_tables  # noqa: E402
from loanloom.sources.request_views import requests  # noqa: E402
from loanloom.sources.shared import written  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SHORT = 6.0


def cases(spark, sf_dir):
    t = lending_tables(spark, sf_dir)
    profile = t["customer_profile"]

    def block(*names):
        few = {n: t[n] for n in names}
        return lambda: feature_blocks(few, closed_labels=True)[names[-1]]

    def report():
        return quality.quality_report(block("prior_loan_history")(), "prior_loan_history")

    def scored():
        return risk.with_decision(risk.rule_score(profile))

    threads = spark.sparkContext.defaultParallelism
    arriving = written(requests(spark, sf_dir).repartition(threads), "arriving")

    def request_features():
        return payload_features(payload.route(arriving), closed_labels=True)

    return {
        "block_credit_summary": block("credit_summary"),
        "block_credit_timeline": block("credit_summary", "credit_timeline"),
        "block_card_activity": block("card_activity"),
        "block_cash_pos": block("cash_pos_records"),
        "block_installments": block("installment_records"),
        "block_prior_loans": block("prior_loan_history"),
        "timeline_open_labels": lambda: credit_timeline.block(
            t["credit_timeline"], t["credit_summary"]
        ),
        "card_last_n_avg": lambda: card_activity.last_months(t["card_activity"]),
        "wide_features": lambda: wide_features(t, closed_labels=True),
        "wide_features_open_labels": lambda: wide_features(t),
        "quality_report": report,
        "rule_score": scored,
        "top3_explanations": lambda: rule_explanations(scored()),
        "stratified_split": lambda: labels.stratified_split(profile),
        "payload_features": request_features,
    }


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    lending_tables(spark, SF_DIR)["credit_summary"].groupBy("CUSTOMER_ID").count().count()
    seconds = {}
    for name, build in cases(spark, SF_DIR).items():
        runs = [timed(build)]
        if runs[0] < SHORT:
            runs += [timed(build), timed(build)]
        seconds[name] = round(statistics.median(runs), 3)
    scale = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "feature_and_scoring_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
