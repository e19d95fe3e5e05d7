"""Annotation of targets with the terms of the features that they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import down, overlap_join
from loomseq.schemas import MAX_ANNOTATIONS
from loomseq.sources.bed import read_bed, terms

#: Bins of 2**20 bases are sorted by themselves.
BIN_BITS = 20
#: Bases of the longest target, which may reach over a bin's edge.
LONGEST = 1 << 16


def decode(mask: Column, names: list[str]) -> Column:
    """The terms of a mask's bits in order, joined by commas; null for none."""
    on = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(t)) for i, t in enumerate(names)]
    text = F.concat_ws(",", *on)
    return F.when(text != "", text)


def footprint(report: DataFrame, pam_length: int) -> DataFrame:
    """``report`` with ``_from`` and ``_to``: the target's bases, gaps not counted, with its PAM, half-open from 0."""
    bases = F.length(F.translate("target_aligned", "-", ""))
    return report.withColumn("_from", F.col("start") - 1).withColumn("_to", F.col("start") - 1 + bases)


def annotate(report: DataFrame, bed: DataFrame, column: str, pam_length: int) -> DataFrame:
    """``report`` with ``column``: the terms of all features that a target's bases overlap, in the order of the dictionary; null if none.

    A target [from, to) overlaps a feature of a term if, of that term's features that begin before ``to``, one ends
    after ``from``: a running maximum of ends, one per term. Targets and features are sorted together in bins of a
    contig, so a target moves once and no pairs are made; a feature that reaches into later bins is counted at their
    beginning, each term's longest alone.
    """
    names = terms(bed)
    if column in report.columns:
        raise ValueError(f"the report has a column {column} already")

    def bin_of(place: Column) -> Column:
        return down(place, F.lit(BIN_BITS))

    size = F.col("_to") - F.col("_from")
    at = F.when(size > LONGEST, F.raise_error(F.lit(f"a target of over {LONGEST} bases")).cast("long")).when(size > 0, (F.col("_to") - 1).cast("long"))
    targets = footprint(report, pam_length).select(*report.columns, F.col("_from").cast("long").alias("_from"), at.alias("_at")).withColumn("_bin", bin_of(F.col("_at")))
    of = F.coalesce(*[F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(names)], F.lit(None).cast("int"))
    begin, end = F.col("bed_start").cast("long"), F.col("bed_end").cast("long")
    features = bed.where(F.col("chrom").isNotNull() & (end > begin)).select(F.col("chrom").alias("chromosome"), begin.alias("_at"), bin_of(begin).alias("_bin"), end.alias("_end"), of.alias("_term"))
    final = bin_of(F.col("_end") - 1 + LONGEST)  # a target that begins before this end may have its own in the next bin
    longest = features.where(final > F.col("_bin")).groupBy("chromosome", "_bin", "_term").agg(F.max("_end").alias("_end"))
    later = longest.withColumn("_bin", F.explode(F.sequence(F.col("_bin") + 1, final))).select("chromosome", F.call_function("shiftleft", "_bin", F.lit(BIN_BITS)).alias("_at"), "_bin", "_end", "_term")
    both = targets.unionByName(features.unionByName(later), allowMissingColumns=True)
    upto = Window.partitionBy("chromosome", "_bin").orderBy("_at", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = both.select("*", *[F.max(F.when(F.col("_term") == i, F.col("_end"))).over(upto).alias(f"_e{i}") for i in range(len(names))])
    mask = F.lit(0).cast("long")
    for i in range(len(names)):
        mask = mask.bitwiseOR(F.when(F.col(f"_e{i}") > F.col("_from"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return ends.where(F.col("_end").isNull()).select(*report.columns, F.when(F.col("_at").isNotNull() & F.col("chromosome").isNotNull(), decode(mask, names)).alias(column))


def annotate_all(spark: SparkSession, report: DataFrame, beds: list[str], names: list[str] | None, pam_length: int) -> DataFrame:
    """One column per BED file, named as given or ``annotation_<i>``; at most MAX_ANNOTATIONS files."""
    names = names or [f"annotation_{i}" for i in range(len(beds))]
    if len(beds) > MAX_ANNOTATIONS or len(names) != len(beds) or len(set(names)) != len(names):
        raise ValueError(f"at most {MAX_ANNOTATIONS} annotation files, each with a name of its own")
    for path, name in zip(beds, names, strict=True):
        report = annotate(report, read_bed(spark, path), name, pam_length)
    return report


def fetch_lines(intervals: DataFrame, gff: DataFrame) -> DataFrame:
    """``intervals`` (``contig, start, stop``) with ``lines``: the overlapping lines of a GFF in order of start, joined by commas; null if none."""
    pairs = overlap_join(intervals.select("contig", "start", "stop").distinct(), gff, ("contig", "chrom"), ("start", "stop"), ("gff_start", "gff_end"))
    own = pairs.groupBy("contig", "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gff_start", "line"))), lambda x: x["line"]), ",").alias("lines"))
    return intervals.join(own, ["contig", "start", "stop"], "left")
