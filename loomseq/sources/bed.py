"""BED and GFF files as interval tables, and the dictionary of a BED's terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.schemas import MAX_TERMS


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, at`` of a file without blank lines and comments; ``at`` orders the lines of one file."""
    raw = spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("line"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    return raw.where((F.trim("line") != "") & ~F.col("line").startswith("#"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, bed_start, bed_end, term, at`` of a BED file, plain or gzip. Fields are split at tabs; fewer than four, an empty term or a bad number is an error."""
    f = F.split("line", "\t", -1)
    odd = (F.size(f) < 4) | (F.get(f, 3) == "") | F.get(f, 1).try_cast("long").isNull() | F.get(f, 2).try_cast("long").isNull()
    ok = F.when(odd, F.raise_error(F.concat(F.lit(f"{path}: no BED line with a term: "), F.col("line")))).otherwise(F.get(f, 0))
    return _lines(spark, path).select(ok.alias("chrom"), F.get(f, 1).try_cast("long").alias("bed_start"), F.get(f, 2).try_cast("long").alias("bed_end"), F.get(f, 3).alias("term"), "at")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, gff_start, gff_end, line`` of a GFF file, its range made half-open from 0."""
    f = F.split("line", "\t", -1)
    return _lines(spark, path).where(F.size(f) >= 8).select(F.get(f, 0).alias("chrom"), (F.get(f, 3).cast("long") - 1).alias("gff_start"), F.get(f, 4).cast("long").alias("gff_end"), "line")


def terms(bed: DataFrame, most: int = MAX_TERMS) -> list[str]:
    """The distinct terms in order of their first line; a term's place is its bit. More than ``most`` is an error."""
    order = F.col("at") if "at" in bed.columns else F.struct("chrom", "bed_start", "bed_end")
    got = bed.groupBy("term").agg(F.min(order).alias("first")).orderBy("first").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} terms")
    return [r["term"] for r in got]
