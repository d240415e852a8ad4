"""Checks of documents as they arrive. Whole documents come in one batch, so document rules hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import paragraphs_of
from ..operators.issues import Settings, counts
from ..plans.pipeline import Resources, check


def check_stream(documents: DataFrame, out: str, checkpoint: str, resources: Resources | None = None, settings: Settings | None = None) -> StreamingQuery:
    """Start a query that writes the issues and totals of every micro-batch of documents (doc_id, text).

    A batch is written to a folder of its own number, so that a batch that is run again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        issues = check(paragraphs_of(batch), resources, settings)
        issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
        counts(batch.sparkSession.read.parquet(f"{out}/issues/batch={number}")).write.mode("overwrite").parquet(f"{out}/totals/batch={number}")

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
