"""Interval joins: overlap of two interval tables, and points in intervals, half-open and from 0.

Each interval is filed on the level of bins that fits its length (bins of 4**level bases), so it lies in at most two
bins of its level whatever its length; a probe looks at those levels alone that the table has. The join is an equi-join on
(contig, level, bin) with the exact condition on top: no nested loop, and no contig or long interval makes one task's
work.

Where only a minimum or maximum over the intervals at a point is wanted, pairs need not be made: ``tiles`` cuts
intervals into aligned ranges of 2**j bases, which are aggregated by themselves, and a point reads one row of each j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.operators.stored import stored

FIRST_LEVEL, LAST_LEVEL = 3, 18  # bins from 64 bases to 4**18, more than any contig has


def _level(length: Column) -> Column:
    level = F.ceil(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.log(F.lit(4.0))).cast("int")
    return F.least(F.greatest(level, F.lit(FIRST_LEVEL)), F.lit(LAST_LEVEL))


def _width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level * 2)


def _bins(start: Column, end: Column, width: Column) -> Column:
    return F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor((end - 1) / width)))


def file_intervals(table: DataFrame, start: str, end: str) -> DataFrame:
    """``table`` with ``_level`` and ``_bin``, one row for each of an interval's one or two bins. Empty intervals and nulls overlap nothing and go."""
    leveled = table.where(F.col(end) > F.col(start)).withColumn("_level", _level(F.col(end) - F.col(start)))
    return leveled.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), _width(F.col("_level")))))


def _filed(table: DataFrame, start: str, end: str) -> tuple[DataFrame, Column]:
    """The filed table, stored, and the array of the levels that occur in it, at most LAST_LEVEL of them."""
    filed = stored(file_intervals(table, start, end), "intervals")
    levels = sorted(r["_level"] for r in filed.select("_level").distinct().collect())
    return filed, F.array(*[F.lit(x) for x in levels]).cast("array<int>")


def probe_intervals(probes: DataFrame, start: str, end: str, levels: Column) -> DataFrame:
    """``probes`` with ``_level`` and ``_bin`` for each bin that they touch of each of ``levels``."""
    leveled = probes.where(F.col(end) > F.col(start)).withColumn("_level", F.explode(levels))
    return leveled.withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), _width(F.col("_level")))))


def overlap_join(probes: DataFrame, table: DataFrame, on: tuple[str, str], probe: tuple[str, str], interval: tuple[str, str], how: str = "inner") -> DataFrame:
    """Rows of ``probes`` with each row of ``table`` whose interval overlaps theirs on the same contig.

    ``on``: the contig's column in either table; the tables share no column names. A pair that meets in two bins
    counts in the first alone. ``how``: inner, or left_semi for the probes that overlap anything.
    """
    (pc, tc), (ps, pe), (ts, te) = on, probe, interval
    t, levels = _filed(table, ts, te)
    p = probe_intervals(probes, ps, pe, levels).withColumnsRenamed({"_level": "_plevel", "_bin": "_pbin"})
    width = _width(F.col("_level"))
    first = F.greatest(F.floor(F.col(ps) / width), F.floor(F.col(ts) / width))
    meets = (F.col(pc) == F.col(tc)) & (F.col("_plevel") == F.col("_level")) & (F.col("_pbin") == F.col("_bin")) & (F.col(ts) < F.col(pe)) & (F.col(te) > F.col(ps))
    joined = p.join(t, meets & (F.col("_bin") == first), "inner").drop("_level", "_bin", "_plevel", "_pbin")
    if how == "left_semi":
        return joined.select(*probes.columns).distinct()
    return joined


def point_join(points: DataFrame, table: DataFrame, on: tuple[str, str], point: str, interval: tuple[str, str]) -> DataFrame:
    """Rows of ``points`` with each row of ``table`` whose interval holds the point."""
    (pc, tc), (ts, te) = on, interval
    t, levels = _filed(table, ts, te)
    p = points.withColumn("_plevel", F.explode(levels)).withColumn("_pbin", F.floor(F.col(point) / _width(F.col("_plevel"))))
    holds = (F.col(pc) == F.col(tc)) & (F.col("_plevel") == F.col("_level")) & (F.col("_pbin") == F.col("_bin")) & (F.col(point) >= F.col(ts)) & (F.col(point) < F.col(te))
    return p.join(t, holds, "inner").drop("_level", "_bin", "_plevel", "_pbin")


def reach(length: Column) -> Column:
    """The largest j with 2**j <= length, or, for what rounding may do, one more."""
    return F.floor(F.log2(length.cast("double")) + 1e-6).cast("int")


def down(value: Column, by: Column) -> Column:
    """floor(value / 2**by)."""
    return F.call_function("shiftright", value, by)


def tiles(table: DataFrame, start: str, end: str) -> DataFrame:
    """``table`` with ``_j, _i``: one row for each of the aligned ranges [_i * 2**_j, (_i + 1) * 2**_j) that tile an interval, at most two of each j. Empty intervals and nulls go."""
    a, b, side = F.col(start), F.col(end), F.col("_k").bitwiseAND(F.lit(1))
    cut = table.where(b > a).withColumn("_k", F.explode(F.sequence(F.lit(0), 2 * reach(b - a) + 1))).withColumn("_j", down(F.col("_k"), F.lit(1)))
    first, last = -down(-a, F.col("_j")), down(b, F.col("_j"))
    odd = F.when(side == 0, first).otherwise(last).bitwiseAND(F.lit(1).cast("long")) == 1
    return cut.where((first < last) & odd).withColumn("_i", F.when(side == 0, first).otherwise(last - 1)).drop("_k")
