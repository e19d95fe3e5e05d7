"""The report of a search: hits rendered as rows, and its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import bulge_type, cas_system, check, edit_distance
from loomseq.functions.cfd import PAM_WEIGHTS, Weights, cfd
from loomseq.schemas import MAX_ANNOTATIONS, REPORT, SCORES, report_schema


def report(hits: DataFrame, pam: str, upstream: bool = False, weights: Weights | None = None, pam_weights: dict[str, float] = PAM_WEIGHTS) -> DataFrame:
    """A row of the report for each hit (``contig, strand, pos, window, rguide, rseq, offset, mm, bdna, brna``).

    ``start`` is from 1: where the target, with its PAM, begins on the forward strand. The guide's column has the PAM
    as given, the target's the PAM as found. CFD is computed for PAMs of SpCas9 and xCas9; without a table of weights
    it is null for targets with a mismatch. The other scores have no definition and are null.
    """
    pam = check(pam)
    found = F.left(F.col("window"), F.lit(len(pam))) if upstream else F.right(F.col("window"), F.lit(len(pam)))
    shifted = F.col("strand") == ("-" if upstream else "+")  # the pad lies before the target on the forward strand
    start = F.when(shifted, F.col("pos") + F.col("offset")).otherwise(F.col("pos")) + 1

    def join(aligned: Column, motif: Column) -> Column:
        return F.concat(motif, aligned) if upstream else F.concat(aligned, motif)

    scored = cas_system(pam, upstream) in ("SpCas9", "xCas9")
    score = cfd(F.col("rguide"), F.col("rseq"), found, weights, pam_weights) if scored else F.lit(None).cast("float")
    return hits.select(
        F.col("contig").alias("chromosome"),
        start.cast("long").alias("start"),
        "strand",
        join(F.col("rguide"), F.lit(pam)).alias("sgRNA_aligned"),
        join(F.col("rseq"), found).alias("target_aligned"),
        F.col("mm").alias("mismatches"),
        F.col("bdna").alias("dna_bulges"),
        F.col("brna").alias("rna_bulges"),
        bulge_type(F.col("bdna"), F.col("brna")).alias("bulge_type"),
        edit_distance(F.col("mm"), F.col("bdna"), F.col("brna")).alias("edit_distance"),
        score.alias("CFD_score"),
        *[F.lit(None).cast("float").alias(c) for c in SCORES[1:]],
    )


def two_decimals(score: Column) -> Column:
    """A score as reports show it: two decimals, NA for null and NaN."""
    return F.when(score.isNull() | F.isnan(score), "NA").otherwise(F.format_string("%.2f", score.cast("double")))


def rendered(rows: DataFrame) -> DataFrame:
    """All columns as text: scores with two decimals, NA for nulls."""
    return rows.select(*[(two_decimals(F.col(c)) if c in SCORES else F.coalesce(F.col(c).cast("string"), F.lit("NA"))).alias(c) for c in rows.columns])


def write_report(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated text with a header, as a folder of part files; one part in report order if ``single_file``."""
    from loomseq.operators.cluster import sort_report

    out = rendered(sort_report(rows) if single_file else rows)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def read_report(spark: SparkSession, path: str, extra: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A report's rows: the 14 columns and up to ten annotation columns, by position, NA as null.

    ``extra``: names of the columns beyond 14, else those of the file's header. ``types``: their types where not
    string. A row of another number of fields, or a field that can't be read as its type, is an error.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False)
    names = raw.option("inferSchema", False).csv(path).columns
    if names[: len(REPORT)] != REPORT or len(names) > len(REPORT) + MAX_ANNOTATIONS + len(types or {}):
        raise ValueError(f"{path}: the header isn't a report's: {names}")
    extra = extra if extra is not None else names[len(REPORT) :]
    if len(extra) != len(names) - len(REPORT):
        raise ValueError(f"{path}: {len(names)} columns, {len(REPORT) + len(extra)} expected")
    schema = report_schema() + "".join(f", `{c}` {(types or {}).get(c, 'string')}" for c in extra)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "NA").option("mode", "FAILFAST").csv(path)

