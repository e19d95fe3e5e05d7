"""Exact dedup by a tree merge of sorted digest runs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents, keyed_join

FAN_IN = 8
_RUN = ["text_sha256", "_n", "_x"]


def merge_runs(digests: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """Winners per digest: ``text_sha256, _n, _x, keep_id, group_size``.

    ``digests`` has ``doc_id, text_sha256, _n, _x, _run``; runs are numbered from 0 up to ``runs``. Each round writes
    every run in digest order, equal digests already folded, and brings together the runs whose numbers agree but for
    the lowest digit in base ``fan_in``: a task merges the sorted pieces of up to ``fan_in`` runs and keeps a digest's
    smallest identifier and its count. That is a sort aggregate on either side of an exchange; Spark picks it for the
    buffer's type, and its sort takes sorted pieces as they are (it merges natural runs). After log(runs) rounds one
    run is left. A run is dealt to tasks by its digests, so none is one task's work, and a digest meets at most
    ``fan_in`` of its own rows, so even a group that holds most of the corpus stays cheap. Digests only count as equal
    if the text's length and a second hash agree too, at every level.
    """

    def merged(rows: DataFrame, best: Column, size: Column) -> DataFrame:
        return rows.groupBy("_run", *_RUN).agg(F.min(best).alias("_best"), size.alias("group_size"))

    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    level = digests.withColumn("_run", F.floor(F.col("_run") / fan_in))
    level, runs = merged(level, best, F.count(F.lit(1))), -(-runs // fan_in)
    while runs > 1:
        level = merged(level.withColumn("_run", F.floor(F.col("_run") / fan_in)), F.col("_best"), F.sum("group_size"))
        runs = -(-runs // fan_in)
    return level.select(*_RUN, F.col("_best.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space; null is an empty text, and
    empty texts form a group like any other. The smallest identifier of a group stays. A null identifier never stays
    beside others; a group of null identifiers only keeps none. Rows that repeat an identifier and its text are all
    marked alike. Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_t"))
    digests = scratch.table(
        rows.select("doc_id", F.sha2("_t", 256).alias("text_sha256"), F.length("_t").alias("_n"), F.xxhash64("_t").alias("_x")),
        "digests",
    )
    # A run is what one task reads of the digests, which are far fewer bytes than the texts.
    runs = digests.select(F.spark_partition_id().alias("r")).agg(F.max("r").alias("r")).first()["r"] or 0
    numbered = digests.withColumn("_run", F.least(F.spark_partition_id(), F.lit(runs)))
    winners = scratch.table(merge_runs(numbered, runs + 1, fan_in), "winners")
    out = keyed_join(digests, winners, _RUN, "group_size", digests.count())
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = min(doc_id) OVER w, false) AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
}
