"""Discovery of assemblies: the FASTA file and the chain of each sample's haplotypes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import pansn
from loomseq.sources.fasta import ASSEMBLY_GLOB

CHAIN_GLOB = "*.{chain,chain.gz}"
CHAIN_NAME = r"^(.+?)_hap(\d+)_"


@dataclass
class Assemblies:
    """``files``: ``sample, hap, fasta, chain``; ``layout``: the haplotypes of each sample."""

    files: list[tuple[str, int, str, str]]

    @property
    def layout(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for sample, hap, _, _ in self.files:
            out.setdefault(sample, []).append(hap)
        return out


def match_manifest(fastas: DataFrame, chains: DataFrame) -> DataFrame:
    """``sample, hap, fasta, chain, problem`` of every key of either table (``sample, hap`` and ``fasta`` or ``chain``).

    Problems: a missing or repeated file. Null means the pair is complete.
    """
    f = fastas.groupBy("sample", "hap").agg(F.min("fasta").alias("fasta"), F.count(F.lit(1)).alias("nf"))
    c = chains.groupBy("sample", "hap").agg(F.min("chain").alias("chain"), F.count(F.lit(1)).alias("nc"))
    both = f.join(c, ["sample", "hap"], "full_outer")
    problem = F.when(F.col("fasta").isNull(), "no FASTA").when(F.col("chain").isNull(), "no chain").when(F.col("nf") > 1, "several FASTA files").when(F.col("nc") > 1, "several chains")
    return both.select("sample", "hap", "fasta", "chain", problem.alias("problem"))


def fasta_keys(spark: SparkSession, folder: str) -> DataFrame:
    """``sample, hap, fasta``: by the first header of each file, which names ``sample#haplotype#contig``."""
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", ASSEMBLY_GLOB).text(folder)
    named = raw.select(F.regexp_extract("value", r"^\s*>?\s*(\S*)", 1).alias("name"), F.col("_metadata.file_path").alias("fasta"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    first = named.groupBy("fasta").agg(F.min_by("name", "at").alias("name"))
    p = pansn(F.col("name"))
    checked = F.when(p.isNull(), F.raise_error(F.concat(F.lit("no header of the form sample#haplotype#contig: "), F.col("name"), F.lit(" in "), F.col("fasta")))).otherwise(p["sample"])
    return first.select(checked.alias("sample"), p["hap"].alias("hap"), "fasta")


def chain_keys(spark: SparkSession, folder: str) -> DataFrame:
    """``sample, hap, chain``: by the beginning of each file's name, ``<sample>_hap<number>_``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", CHAIN_GLOB).load(folder).select(F.col("path").alias("chain"))
    name = F.element_at(F.split("chain", "/"), -1)
    bad = ~name.rlike(CHAIN_NAME)
    sample = F.when(bad, F.raise_error(F.concat(F.lit("a chain's name begins with <sample>_hap<number>_: "), name))).otherwise(F.regexp_extract(name, CHAIN_NAME, 1))
    return files.select(sample.alias("sample"), F.regexp_extract(name, CHAIN_NAME, 2).try_cast("int").alias("hap"), "chain")


def discover(spark: SparkSession, assemblies: str, chains: str) -> Assemblies:
    """All haplotypes, in order, after a check: each has one FASTA file and one chain, and all samples have as many haplotypes. One line per file comes to the driver."""
    rows = match_manifest(fasta_keys(spark, assemblies), chain_keys(spark, chains)).orderBy("sample", "hap").collect()
    bad = [f"{r['sample']}#{r['hap']}: {r['problem']}" for r in rows if r["problem"]]
    if bad or not rows:
        raise ValueError("; ".join(bad[:10]) or "no assemblies found")
    out = Assemblies([(r["sample"], r["hap"], r["fasta"], r["chain"]) for r in rows])
    if len({len(h) for h in out.layout.values()}) > 1:
        raise ValueError(f"samples differ in their number of haplotypes: { {s: len(h) for s, h in out.layout.items()} }")
    return out
