"""Clustering and search over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_clusters(rows: DataFrame, keys: list[str], time: str, gap: str, late: str, *aggs: Column) -> DataFrame:
    """``keys, first, last, n`` and ``aggs`` of each run of events that follow one another within ``gap``: single linkage in event time.

    Session windows merge events exactly ``gap`` apart, as the batch operator does. State is one row per open run and
    goes once the watermark, ``late`` behind the newest event, has passed its end.
    """
    marked = rows.withWatermark(time, late)
    runs = marked.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), *aggs)
    return runs.drop("_w")


def stream_search(contigs: DataFrame, run: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Search each micro-batch of arriving contigs with ``run`` and hand the rows to ``sink`` with the batch's number, by which it can tell a batch that is tried again. Returns the query."""
    return contigs.writeStream.foreachBatch(lambda batch, number: sink(run(batch), number)).option("checkpointLocation", checkpoint).start()
