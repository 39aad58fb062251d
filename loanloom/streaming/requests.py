"""Score requests as they arrive.

Each batch is scored by the batch code and written to a directory of its own that a retry
overwrites, which makes the output exactly-once. Requests are independent; only where repeats are
to be left out does state cross micro-batches, and a watermark on the arrival time bounds it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from loanloom.plans.scoring import Scorer, payload_features, prediction_rows
from loanloom.schemas import REQUEST
from loanloom.sources.payload import parse, rejects

ARRIVED = "arrived"


def request_stream(
    spark: SparkSession, path: str, files_per_batch: int = 100, with_arrival: bool = False
) -> DataFrame:
    """Requests from a directory of JSON lines {REQUEST_ID, body}, and `arrived` if they have it."""
    arrival = f", {ARRIVED} timestamp" if with_arrival else ""
    return (
        spark.readStream.schema(f"{REQUEST} string, body string{arrival}")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def without_repeats(requests: DataFrame, within: str) -> DataFrame:
    """The first arrival of each request; what repeats its id and body is left out.

    A repeat is found if it arrives at most ``within`` after the first; later ones may
    pass, since the state of a request is dropped then. Requests that share only the id
    are different. Needs the column `arrived`; state survives restarts in the checkpoint.
    """
    timed = requests.withWatermark(ARRIVED, within)
    return timed.dropDuplicatesWithinWatermark([REQUEST, "body"]).drop(ARRIVED)


def score_batch(parsed: DataFrame, scorer: Scorer) -> tuple[DataFrame, DataFrame]:
    """(predictions, rejects) of a set of parsed requests."""
    return prediction_rows(scorer(payload_features(parsed))), rejects(parsed)


def start_scoring(
    requests: DataFrame,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    available_now: bool = True,
    repeats_within: str | None = None,
):
    """Start the scoring stream; predictions and rejects land under ``output``.

    With ``repeats_within``, such as '1 hour', repeated requests are scored once.
    """
    if repeats_within is not None:
        requests = without_repeats(requests, repeats_within)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Seven tables read the batch, so it is parsed once and kept while they do.
        parsed = parse(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            predictions, refused = score_batch(parsed, scorer)
            folder = f"batch={batch_id}"
            predictions.write.mode("overwrite").parquet(f"{output}/predictions/{folder}")
            refused.write.mode("overwrite").parquet(f"{output}/rejects/{folder}")
        finally:
            parsed.unpersist()

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return writer.trigger(**trigger).start()


def read_predictions(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/predictions").drop("batch")


def read_rejects(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/rejects").drop("batch")
