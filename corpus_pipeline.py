"""From raw documents to packed sequences, in five stages. Each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import exact_dedup, mixing, near_dedup, packing, quality
from loomseq.llm.common import Scratch


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_key``, 64 bits of hash of all columns: rows that share one are alike in everything."""
    return docs.withColumn("_row_key", F.xxhash64(*docs.columns))


def _take(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` (``_row_key, _rows, _copies``) names, ``_copies`` times. ``_rows`` tells how many are alike: of these, one is taken.

    ``chosen`` grows with ``docs``, so the joins are merge joins at every size, also where Spark would still broadcast it.
    """
    spark = docs.sparkSession
    chosen = Scratch(spark, "chosen").table(chosen, "chosen")
    keyed, several = _keyed(docs), chosen.where("_rows > 1")
    rows = keyed.join(chosen.where("_rows = 1").hint("merge"), "_row_key")
    if not several.isEmpty():
        rows = rows.unionByName(keyed.join(several.hint("merge"), "_row_key").dropDuplicates(["_row_key"]))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def _keep(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group (``_row_key, _group``, one row per row of ``docs``): that of the smallest identifier, null last."""
    groups = groups.groupBy("_row_key").agg(F.min("_group").alias("_group"), F.count(F.lit(1)).alias("_rows"))
    ids = _keyed(docs).select("_row_key", "doc_id").distinct()
    best = ids.join(groups, "_row_key").groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key", "_rows")).alias("b"))
    return _take(docs, best.select("b._row_key", "b._rows", F.lit(1).alias("_copies")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, in place: no shuffle."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, whether it has an identifier or not."""
    return _keep(docs, exact_dedup.exact_dedup(_keyed(docs), "_row_key").select(F.col("doc_id").alias("_row_key"), F.col("keep_id").alias("_group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return _keep(docs, near_dedup.near_duplicates(_keyed(docs), "_row_key").select(F.col("doc_id").alias("_row_key"), F.col("component_id").alias("_group")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    named = _keyed(docs).withColumn("_row_id", F.struct("doc_id", "_row_key"))
    copies = mixing.mix(named, "_row_id").groupBy(F.col("doc_id._row_key").alias("_row_key")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies"))
    return _take(docs, copies.where("_copies > 0"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's pieces and their places in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
