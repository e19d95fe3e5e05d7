"""Clusters of nearby rows and the primary row of each."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.stored import stored


#: Positions in one task's share of a key.
BIN = 1 << 20
#: Rows in one task's share of all bins, where rows are counted.
SHARE = 1 << 18


def tasks_for(rows: DataFrame) -> int:
    """Tasks that take SHARE of ``rows`` each, as many as there are cores at least. Rows are counted, so they should be stored ones."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SHARE))


def single_linkage(rows: DataFrame, keys: list[str], position: str, gap: int, bin_width: int = BIN, unique: bool = False, kind: str | None = None, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``cluster_start`` (the cluster's first position) and ``cluster_no`` (from 0 within the keys).

    Sorted by position, a row joins the cluster of the one before if it is at most ``gap`` away. Only distinct
    positions are sorted, in bins of ``bin_width``, so neither a long contig nor a crowded place makes one task's work;
    what a bin needs from those before it, whether its first cluster goes on from there, where that began and the
    number of clusters so far, comes from one row per bin. Bins are dealt out and sorted by the columns that join them
    with these rows, so the join neither moves nor sorts anything again.
    Keys may be null, which is a key like any other; a null position makes a cluster of its own with null start.
    ``unique``: the keys have each position (and ``kind``) once, so rows are sorted themselves and not joined back.
    ``kind``, for unique rows: a column by which equal positions are ordered, and whose every change also ends a
    cluster.
    ``tasks``: tasks among which bins are dealt, as by ``tasks_for``; Spark's number, which doesn't grow with the
    rows, if None.
    """
    if kind and not unique:
        raise ValueError("kinds need unique rows")
    whole = {c: t for c, t in rows.dtypes if c == position and t in ("tinyint", "smallint", "int", "bigint")}
    own = {k: F.col(f"_k._{i}") for i, k in enumerate(keys)} | {c: F.col("_p").cast(t) for c, t in whole.items()}  # told by the columns below, so not carried twice
    rest = [c for c in rows.columns if c not in own] if unique else []
    at = [F.struct(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.lit(0).alias("_")).alias("_k"), F.col(position).cast("long").alias("_p"), (F.col(kind) if kind else F.lit(0)).alias("_a")]
    places = rows.where(F.col(position).isNotNull()).select(*rest, *at)
    places = (places if unique else places.distinct()).withColumn("_b", F.floor(F.col("_p") / bin_width))
    bin_ = ["_h", "_k", "_b"]
    places = places.withColumn("_h", F.xxhash64("_k", "_b"))  # first in the order, as numbers sort faster than structs
    places = places.repartition(tasks, *bin_) if tasks else places
    here = F.struct("_p", "_a")

    def fresh(at: Column, prev: Column) -> Column:
        return F.when(prev.isNull() | (at["_p"] - prev["_p"] > gap) | (prev["_a"] != at["_a"]), 1).otherwise(0)

    within = Window.partitionBy(*bin_).orderBy("_p", "_a")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    begun = places.withColumn("_new", fresh(here, F.lag(here).over(within)))
    local = begun.withColumn("_n", F.sum("_new").over(upto)).withColumn("_s", F.max(F.when(F.col("_new") == 1, F.col("_p"))).over(upto))
    bins = local.groupBy(*bin_).agg(F.min(here).alias("_min"), F.max(here).alias("_max"), F.max("_n").alias("_total"), F.max("_s").alias("_open"))
    before = Window.partitionBy("_k").orderBy("_b")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_on", 1 - fresh(F.col("_min"), F.lag("_max").over(before)))
    carried = bins.select(
        *bin_, "_on", F.coalesce(F.sum(F.col("_total") - F.col("_on")).over(earlier), F.lit(0)).alias("_offset"), F.max(F.when(F.col("_total") > F.col("_on"), F.col("_open"))).over(earlier).alias("_carry")
    )
    joined = local.join(carried, bin_, "left")  # every bin has its row; an inner join would filter nulls first and so not share the exchange
    number = F.col("_n") - F.col("_on")  # 0 in the cluster that goes on from the bins before
    found = [F.when(number == 0, F.col("_carry")).otherwise(F.col("_s")).alias("cluster_start"), (number + F.col("_offset") - 1).cast("long").alias("cluster_no")]
    if unique:
        none = rows.where(F.col(position).isNull()).select("*", F.lit(None).cast("long").alias("cluster_start"), F.lit(None).cast("long").alias("cluster_no"))
        return joined.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in rows.columns], *found).unionByName(none)
    numbered = joined.select("_k", "_p", *found)
    on = F.col(position).cast("long") == F.col("_p")
    for i, name in enumerate(keys):
        on = on & F.col(name).eqNullSafe(F.col(f"_k._{i}"))
    return rows.join(numbered, on, "left").select(*rows.columns, "cluster_start", "cluster_no")


# Names of ranking criteria, their report columns, and whether less is better.
CRITERIA = {"edit-dist": ("edit_distance", True), "bdna": ("dna_bulges", True), "brna": ("rna_bulges", True), "mm": ("mismatches", True), "cfd": ("CFD_score", False), "crista": ("CRISTA_score", False), "elevation": ("Elevation_score", False)}
DEFAULT_CRITERIA = ["edit-dist", "bdna", "brna", "mm"]


def parse_criteria(spec: str | list[str] | None) -> list[str]:
    """Names of criteria, of any case, from a list or a comma-separated text. None or unknown ones are an error; scores that are never computed get a warning, as they rank nothing."""
    if spec is None:
        return list(DEFAULT_CRITERIA)
    names = [x.strip().lower() for x in (spec.split(",") if isinstance(spec, str) else spec)]
    if not names or any(n not in CRITERIA for n in names):
        raise ValueError(f"ranking criteria are a list of {', '.join(CRITERIA)}; not {spec!r}")
    for n in names:
        if n in ("crista", "elevation"):
            warnings.warn(f"{n} is never computed, so it ranks nothing", stacklevel=2)
    return names


def ranking(criteria: list[str] | None = None) -> list[Column]:
    """Columns whose ascending order is the rank: nulls and NaN last, then strand (- first) and target."""
    out = []
    for name in criteria or DEFAULT_CRITERIA:
        column, asc = CRITERIA[name]
        value = F.col(column).cast("double")
        value = F.when(F.isnan(value), None).otherwise(value if asc else -value)
        out += [value.isNull().cast("int"), value]
    return [*out, F.when(F.col("strand") == "+", 1).otherwise(0), F.col("target_aligned")]


def line(columns: list[str]) -> Column:
    """A row as a line of the report."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


def split_primary(rows: DataFrame, cluster: list[str], order: list[Column], columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(primary, alternative): the first row of each cluster by ``order``, then by start and the whole line; and all other rows.

    Rows are stored with a number each. The first row is a grouped minimum, which partial sums make cheap however many
    rows a cluster has; the others are those whose number it doesn't have, so rows that repeat stay as often as they
    should. Together they are ``rows``.
    """
    columns = columns or rows.columns
    rows = stored(rows.withColumn("_no", F.monotonically_increasing_id()), "numbered")
    ranks = [x.alias(f"_o{i}") for i, x in enumerate([*order, F.col("start"), line([c for c in columns if c not in cluster]), F.col("_no")])]
    best = stored(rows.groupBy(*[F.col(c) for c in cluster]).agg(F.min(F.struct(*ranks, F.struct(*[F.col(c) for c in columns]).alias("_row"))).alias("_m")).select(F.col(f"_m._o{len(ranks) - 1}").alias("_no"), "_m._row"), "primary")
    return best.select("_row.*"), rows.join(best.select("_no"), "_no", "left_anti").select(*columns)


def partition_report(report: DataFrame, distance: int = 3, criteria: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(primary, alternative) of a report: clusters of one contig and strand whose starts are at most ``distance`` apart, the best row of each, and the rest."""
    if distance <= 0:
        raise ValueError("the cluster distance has to be above 0")
    columns = report.columns
    report = stored(report, "report")
    clustered = single_linkage(report, ["chromosome", "strand"], "start", distance, tasks=tasks_for(report))
    primary, alternative = split_primary(clustered, ["chromosome", "strand", "cluster_start"], ranking(criteria))
    return primary.select(*columns), alternative.select(*columns)


def sort_report(report: DataFrame) -> DataFrame:
    """Rows in the order of the report's files: contig, strand (- first), start, whole line."""
    return report.orderBy("chromosome", F.when(F.col("strand") == "+", 1).otherwise(0), "start", line(report.columns))


def partition_statistics(report: DataFrame, distance: int = 3) -> DataFrame:
    """One row: ``clusters, primary, alternative``."""
    report = stored(report, "report")
    clustered = single_linkage(report, ["chromosome", "strand"], "start", distance, tasks=tasks_for(report))
    per = clustered.groupBy("chromosome", "strand", "cluster_start").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("clusters"), F.count(F.lit(1)).alias("primary"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("alternative"))


