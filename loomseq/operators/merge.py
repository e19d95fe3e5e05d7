"""Merging the lifted reports of haplotypes into one report of all samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import flip_strand
from loomseq.operators.cluster import DEFAULT_CRITERIA, line, ranking, single_linkage
from loomseq.operators.stored import stored
from loomseq.schemas import MERGED, REPORT

MAX_PLOIDY = 16


def sample_table(spark: SparkSession, layout: dict[str, list[int]]) -> DataFrame:
    """``sample_id, sample, hap_id, bit, ploidy``: samples in order of name, each with its haplotypes in order of number; a haplotype's place is its bit."""
    rows = []
    for i, (name, haps) in enumerate(sorted(layout.items())):
        if len(set(haps)) != len(haps) or not 0 < len(haps) <= MAX_PLOIDY:
            raise ValueError(f"{name}: from 1 to {MAX_PLOIDY} different haplotypes are needed")
        rows += [(i, name, h, b, len(haps)) for b, h in enumerate(sorted(haps))]
    return spark.createDataFrame(rows, "sample_id int, sample string, hap_id int, bit int, ploidy int")


def presence_rows(lifted: DataFrame, samples: DataFrame) -> DataFrame:
    """Lifted rows (``sample, hap`` and a lifted report's columns) with their place and presence.

    Where a row mapped, its place is the reference's and its strand flips with the chain; else it is its own.
    ``space`` keeps mapped and unmapped rows apart. A haplotype that the sample table hasn't got is an error, and so is
    an unknown status.
    """
    s = F.broadcast(samples.select("sample", F.col("hap_id").alias("hap"), "sample_id", "bit", "ploidy"))
    joined = lifted.join(s, ["sample", "hap"], "left")
    bit = F.when(F.col("bit").isNull(), F.raise_error(F.concat(F.lit("not in the sample table: "), F.col("sample"), F.lit("#"), F.col("hap").cast("string")))).otherwise(F.col("bit"))
    status = F.when(F.col("map_status").isin("mapped", "ambiguous", "unmapped"), F.col("map_status")).otherwise(F.raise_error(F.concat(F.lit("unknown map_status "), F.col("map_status").cast("string"))))
    mapped = F.col("map_status") != "unmapped"
    return joined.select(
        *[c for c in lifted.columns if c not in ("sample", "hap", "map_status", "hg38_chr", "hg38_pos", "hg38_flipped", "chromosome", "start", "strand")],
        status.alias("map_status"),
        F.when(mapped, F.col("hg38_chr")).otherwise(F.col("chromosome")).alias("chromosome"),
        F.when(mapped, F.col("hg38_pos")).otherwise(F.col("start")).cast("long").alias("start"),
        F.when(mapped, flip_strand(F.col("strand"), F.col("hg38_flipped") == 1)).otherwise(F.col("strand")).alias("strand"),
        mapped.cast("int").alias("space"),
        "sample_id",
        "sample",
        "ploidy",
        F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("mask"),
    )


_OWN = ["space", "chromosome", "strand", "target_aligned"]


def _cluster(rows: DataFrame, keys: list[str], distance: int, adjacent_only: bool, unique: bool) -> DataFrame:
    """``rows`` with ``cluster_start``; with the keys and an allele's own columns it names a row's cluster."""
    if adjacent_only:
        linked = single_linkage(rows, [*keys, *_OWN[:-1]], "start", distance, unique=True, kind=_OWN[-1])
    else:
        linked = single_linkage(rows, [*keys, *_OWN], "start", distance, unique=unique)
    return linked.drop("cluster_no")


def _representative(rows: DataFrame, columns: list[str], criteria: list[str]) -> Column:
    order = [x.alias(f"_o{i}") for i, x in enumerate([*ranking(criteria), F.col("start"), line(columns)])]
    return F.min(F.struct(*order, F.struct(*[F.col(c) for c in columns]).alias("_row"))).alias("_m")


def merge_sample(rows: DataFrame, distance: int = 3, criteria: list[str] | None = None, adjacent_only: bool = False) -> DataFrame:
    """One row per cluster within each sample: the best row, the OR of its annotations, and ``mask``, the sample's copies.

    A cluster is of one sample, space, contig, strand and allele, each start at most ``distance`` from the one before.
    ``adjacent_only``: another allele in between also ends a cluster. Rows of one allele at one start are folded
    before they are linked, so a crowded place is a row a sample.
    """
    criteria = criteria or DEFAULT_CRITERIA
    columns = [c for c in rows.columns if c not in ("mask", "annotation", "sample_id", "sample", "ploidy")]
    rest = [F.bit_or("mask").alias("mask"), F.first("sample").alias("sample"), F.first("ploidy").alias("ploidy"), *([F.bit_or("annotation").alias("annotation")] if "annotation" in rows.columns else [])]
    places = rows.groupBy("sample_id", *_OWN, "start").agg(_representative(rows, columns, criteria), *rest)
    linked = _cluster(places, ["sample_id"], distance, adjacent_only, True)
    folded = linked.groupBy("sample_id", *_OWN, "cluster_start").agg(F.min("_m").alias("_m"), *rest)
    return folded.select("_m._row.*", "sample_id", "sample", "ploidy", "mask", *(["annotation"] if "annotation" in rows.columns else []))


def render_presence(mask: Column, ploidy: Column) -> Column:
    """A copy's bit in each place, in the order of the sample's haplotypes: ``1|0``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), ploidy - 1), lambda b: F.call_function("shiftright", mask, b).bitwiseAND(F.lit(1)).cast("string")), "|")


def merge_global(per_sample: DataFrame, distance: int = 3, criteria: list[str] | None = None, adjacent_only: bool = False) -> DataFrame:
    """One row per cluster over all samples: the best row, the OR of annotations, and ``presence``, an array of (sample_id, sample, mask, ploidy) with a sample once, in order.

    A sample's rows of a cluster are merged before its cluster is put together, so the array is no longer than the
    list of samples.
    """
    criteria = criteria or DEFAULT_CRITERIA
    columns = [c for c in per_sample.columns if c not in ("mask", "annotation", "sample_id", "sample", "ploidy")]
    extra = [F.bit_or("annotation").alias("annotation")] if "annotation" in per_sample.columns else []
    if adjacent_only:  # another sample's allele in between counts too, so places are linked, then looked up by each sample's row
        places = stored(per_sample.select(*_OWN, "start").distinct(), "places")
        starts = _cluster(places, [], distance, True, True).withColumnsRenamed({c: f"_{c}" for c in (*_OWN, "start")})
        same = F.col("start") == F.col("_start")
        for c in _OWN:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        grouped = per_sample.join(starts, same)
    else:
        grouped = _cluster(per_sample, [], distance, False, False)
    each = grouped.groupBy(*_OWN, "cluster_start", "sample_id").agg(_representative(per_sample, columns, criteria), F.bit_or("mask").alias("mask"), F.first("sample").alias("sample"), F.first("ploidy").alias("ploidy"), *extra)
    whole = each.groupBy(*_OWN, "cluster_start").agg(F.min("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("sample_id", "sample", "mask", "ploidy"))).alias("presence"), *extra)
    return whole.select("_m._row.*", "presence", *(["annotation"] if extra else []))


def render_samples(presence: Column) -> Column:
    """``HG1:1|0,HG2:1|1``."""
    return F.array_join(F.transform(presence, lambda p: F.concat(p["sample"], F.lit(":"), render_presence(p["mask"], p["ploidy"]))), ",")


def union_presence(a: Column, b: Column) -> Column:
    """Two presence arrays as one: a sample once, the OR of its masks."""
    ids = F.array_sort(F.array_distinct(F.concat(F.transform(a, lambda x: x["sample_id"]), F.transform(b, lambda x: x["sample_id"]))))

    def one(i: Column) -> Column:
        own = F.filter(F.concat(a, b), lambda x: x["sample_id"] == i)
        return F.struct(i.alias("sample_id"), F.get(own, 0)["sample"].alias("sample"), F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x["mask"])).alias("mask"), F.get(own, 0)["ploidy"].alias("ploidy"))

    return F.transform(ids, one)


def merge_assemblies(lifted: DataFrame, samples: DataFrame, distance: int = 3, criteria: list[str] | None = None, adjacent_only: bool = False) -> DataFrame:
    """The merged report: the report's columns, then ``samples`` and ``map_status``. First within samples, then over all."""
    rows = stored(presence_rows(lifted, samples), "presence")
    per_sample = stored(merge_sample(rows, distance, criteria, adjacent_only), "samples")
    merged = merge_global(per_sample, distance, criteria, adjacent_only)
    return merged.select(*REPORT, *(["annotation"] if "annotation" in merged.columns else []), render_samples(F.col("presence")).alias(MERGED[0]), MERGED[1])
