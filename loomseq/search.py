"""Searches from files to reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import check
from loomseq.functions.cfd import Weights
from loomseq.operators.align import Thresholds
from loomseq.operators.annotate import annotate_all
from loomseq.operators.cluster import parse_criteria, partition_report
from loomseq.operators.liftover import TOLERANCE, lift_report
from loomseq.operators.merge import merge_assemblies, sample_table
from loomseq.operators.report import read_report, report, write_report
from loomseq.operators.scan import search_hits
from loomseq.operators.stored import shared_folder
from loomseq.schemas import LIFTED
from loomseq.sources.assembly import Assemblies, discover
from loomseq.sources.chain import read_chain
from loomseq.sources.fasta import REFERENCE_GLOB, check_contigs, check_haplotypes, guides, read_fasta

Transform = Callable[[DataFrame], DataFrame]


def search(contigs: DataFrame, guide: str | list[str], pam: str, caps: Thresholds, upstream: bool = False, transforms: list[Transform] | tuple[Transform, ...] = (), weights: Weights | None = None) -> DataFrame:
    """The report of all guides over all contigs. ``transforms`` are functions from report to report, applied in turn."""
    hits = search_hits(contigs, guides([guide] if isinstance(guide, str) else guide), check(pam), caps, upstream)
    return reduce(DataFrame.transform, transforms, report(hits, pam, upstream, weights))


def search_many(contigs: DataFrame, every: list[str], pam: str, caps: Thresholds, upstream: bool = False, weights: Weights | None = None) -> dict[str, DataFrame]:
    """The report of each guide. The contigs are read and scanned once for all guides; the hits are stored by guide, so each report reads its own alone."""
    spark, pam, every = contigs.sparkSession, check(pam), guides(every)
    path = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex[:12]}"
    hits = search_hits(contigs, every, pam, caps, upstream)
    hits.write.partitionBy("guide").parquet(path)
    kept = spark.read.schema(hits.schema).parquet(path)
    return {g: report(kept.where(F.col("guide") == g), pam, upstream, weights) for g in every}


def search_reference(
    spark: SparkSession,
    fasta: str,
    guide: str,
    pam: str,
    caps: Thresholds,
    *,
    upstream: bool = False,
    annotations: list[str] | None = None,
    annotation_names: list[str] | None = None,
    distance: int = 3,
    criteria: str | list[str] | None = None,
    weights: Weights | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(primary, alternative) report of a guide over a folder of FASTA files."""
    return search_reference_many(spark, fasta, [guide], pam, caps, upstream=upstream, annotations=annotations, annotation_names=annotation_names, distance=distance, criteria=criteria, weights=weights)[guides([guide])[0]]


def search_reference_many(
    spark: SparkSession,
    fasta: str,
    every: list[str],
    pam: str,
    caps: Thresholds,
    *,
    upstream: bool = False,
    annotations: list[str] | None = None,
    annotation_names: list[str] | None = None,
    distance: int = 3,
    criteria: str | list[str] | None = None,
    weights: Weights | None = None,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(primary, alternative) of each guide, over one scan of the genome."""
    ranks = parse_criteria(criteria)
    contigs = check_contigs(read_fasta(spark, fasta, REFERENCE_GLOB))
    found = search_many(contigs, every, pam, caps, upstream, weights)
    return {g: partition_report(annotate_all(spark, rows, annotations or [], annotation_names, len(pam)), distance, ranks) for g, rows in found.items()}


def search_haplotypes(spark: SparkSession, inputs: Assemblies, guide: str | list[str], pam: str, caps: Thresholds, upstream: bool = False, weights: Weights | None = None) -> DataFrame:
    """The report of all haplotypes in one pass, with ``sample`` and ``hap`` by the contigs' names."""
    contigs = check_contigs(check_haplotypes(read_fasta(spark, [f for _, _, f, _ in inputs.files])))
    found = search(contigs, guide, pam, caps, upstream, weights=weights)
    parts = F.split("chromosome", "#", 3)
    return found.withColumn("sample", F.get(parts, 0)).withColumn("hap", F.get(parts, 1).cast("int"))


def lift_haplotypes(spark: SparkSession, found: DataFrame, inputs: Assemblies, tolerance: int = TOLERANCE) -> DataFrame:
    """Each row lifted by its own haplotype's chains: contigs are told apart by sample and haplotype, so one join serves all."""
    keys = spark.createDataFrame([(c, f"{s}#{h}#") for s, h, _, c in inputs.files], "_path string, _key string")
    blocks = read_chain(spark, [c for _, _, _, c in inputs.files]).join(F.broadcast(keys), F.col("file") == F.col("_path")).withColumn("t_name", F.regexp_replace(F.concat("_key", F.substring_index("t_name", "#", -1)), "#", "\x01"))
    tagged = found.withColumn("_name", F.col("chromosome")).withColumn("chromosome", F.regexp_replace("chromosome", "#", "\x01"))
    return lift_report(tagged, blocks, tolerance).withColumn("chromosome", F.col("_name")).drop("_name")


def search_assemblies(
    spark: SparkSession,
    assemblies: str,
    chains: str,
    guide: str | list[str],
    pam: str,
    caps: Thresholds,
    *,
    upstream: bool = False,
    tolerance: int = TOLERANCE,
    distance: int = 3,
    criteria: str | list[str] | None = None,
    weights: Weights | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(primary, alternative) of all samples: search each haplotype, lift, merge, partition."""
    inputs = discover(spark, assemblies, chains)
    ranks = parse_criteria(criteria)
    lifted = lift_haplotypes(spark, search_haplotypes(spark, inputs, guide, pam, caps, upstream, weights), inputs, tolerance)
    merged = merge_assemblies(lifted, sample_table(spark, inputs.layout), distance, ranks)
    return partition_report(merged, distance, ranks)


def report_prefix(guide: str, pam: str, prefix: str | None = None) -> str:
    return prefix or f"{guide}_{pam}"


def write_partitions(primary: DataFrame, alternative: DataFrame, folder: str, prefix: str, single_file: bool = True) -> tuple[str, str]:
    """``<prefix>_primary.tsv`` and ``<prefix>_alternative.tsv``, as folders."""
    paths = tuple(f"{folder.rstrip('/')}/{prefix}_{kind}.tsv" for kind in ("primary", "alternative"))
    for rows, path in zip((primary, alternative), paths, strict=True):
        write_report(rows, path, single_file)
    return paths


# --- files to files ---

_LIFTED_TYPES = {"annotation": "long", "hg38_pos": "long", "hg38_flipped": "int"}


def partition_file(spark: SparkSession, path: str, primary: str, alternative: str, distance: int = 3, criteria: str | list[str] | None = None) -> dict[str, int]:
    """Split a report's file in two with the same header; the numbers of clusters and rows."""
    first, rest = partition_report(read_report(spark, path), distance, parse_criteria(criteria))
    for rows, out in ((first, primary), (rest, alternative)):
        write_report(rows, out, single_file=True)
    n = read_report(spark, primary).count()
    return {"clusters": n, "primary": n, "alternative": read_report(spark, alternative).count()}


def lift_file(spark: SparkSession, path: str, chain: str, out: str, tolerance: int = TOLERANCE) -> dict[str, int]:
    """Add the reference's place to every row of a report's file; the numbers of mapped, ambiguous and unmapped rows."""
    write_report(lift_report(read_report(spark, path), read_chain(spark, chain), tolerance), out, single_file=True)
    counts = read_report(spark, out, types=_LIFTED_TYPES).groupBy("map_status").count().collect()
    return {"mapped": 0, "ambiguous": 0, "unmapped": 0} | {r["map_status"]: r["count"] for r in counts}


def merge_files(spark: SparkSession, lifted: list[tuple[str, int, str]], out: str, distance: int = 3, criteria: str | list[str] | None = None) -> None:
    """Merge lifted reports, given as (sample, haplotype, file), into one."""
    rows, layout = None, {}
    for sample, hap, path in lifted:
        layout.setdefault(sample, []).append(hap)
        own = read_report(spark, path, types=_LIFTED_TYPES)
        missing = [c for c in LIFTED if c not in own.columns]
        if missing:
            raise ValueError(f"{path}: no columns {missing}")
        own = own.withColumn("sample", F.lit(sample)).withColumn("hap", F.lit(hap))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("no reports to merge")
    write_report(merge_assemblies(rows, sample_table(spark, layout), distance, parse_criteria(criteria)), out, single_file=True)
