"""Queries that write the driver's tables in the file formats of the search and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.operators.report import read_report, write_report
from loomseq.operators.stored import scratch_path
from loomseq.plans import genome
from loomseq.sources.bed import read_bed
from loomseq.sources.chain import read_chain
from loomseq.sources.fasta import read_fasta, statistics


def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs as FASTA text of 60 bases a line, read back with their statistics."""
    path = scratch_path(spark, "fasta")
    contigs = genome._contigs(spark, sf_dir)
    contigs.select(F.concat(F.lit(">"), "contig", F.lit(" made of text\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))).write.text(path)
    found = read_fasta(spark, path)
    return found.select("contig", F.md5("seq").alias("seq_md5")).join(statistics(found), "contig")


def bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as BED text, read back."""
    path = scratch_path(spark, "bed")
    genome._features(spark, sf_dir).select(F.concat_ws("\t", "chrom", "bed_start", "bed_end", "term")).write.text(path)
    return read_bed(spark, path).drop("at")


def chain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains as chain text, a header and its blocks each, read back as blocks."""
    path = scratch_path(spark, "chain")
    steps = genome._steps(spark, sf_dir).groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "size"))).alias("steps"))
    rows = genome._chains(spark, sf_dir).join(steps, "chain_id")
    n = F.size("steps")
    sizes = F.aggregate("steps", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    gaps = F.aggregate(F.slice("steps", F.lit(1), n - 1), F.lit(0).cast("long"), lambda acc, x: acc + x["step_no"])
    head = F.concat_ws(" ", F.lit("chain"), "score", "t_name", F.lit(10**9), F.lit("+"), "t_start", F.col("t_start") + sizes + gaps, "q_name", "q_size", "q_strand", "q_start", F.col("q_start") + sizes + 2 * gaps, "chain_id")
    blocks = F.transform("steps", lambda x, i: F.when(i == n - 1, x["size"].cast("string")).otherwise(F.concat_ws(" ", x["size"], x["step_no"], 2 * x["step_no"])))
    rows.select(F.concat(head, F.lit("\n"), F.array_join(blocks, "\n"), F.lit("\n"))).write.text(path)
    return read_chain(spark, path).drop("file", "file_order")


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as its files and read back; scores come back with two decimals."""
    path = scratch_path(spark, "report")
    write_report(genome._report(spark, sf_dir), path)
    return read_report(spark, path)


QUERIES = {f.__name__: f for f in (fasta_file, bed_file, chain_file, report_file)}

ORACLE_SQL = {
    "fasta_file": f"WITH {genome._C} SELECT contig, md5(seq) AS seq_md5, length(seq) AS length, 0::BIGINT AS n_count FROM c",
    "bed_file": f"WITH {genome._BED} SELECT chrom, a AS bed_start, z AS bed_end, term FROM bed",
    "chain_file": f"WITH {genome._BLOCKS} SELECT * EXCLUDE (file_order) FROM b",
    "report_file": f"""WITH {genome._R} SELECT * REPLACE (printf('%.2f', "CFD_score"::DOUBLE)::FLOAT AS "CFD_score") FROM r""",
}
