"""Liftover of positions through chain blocks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseq.functions.alphabet import bare_contig
from loomseq.operators.intervals import down, reach, tiles
from loomseq.operators.stored import stored

TOLERANCE = 10


def lift_points(points: DataFrame, blocks: DataFrame, tolerance: int = TOLERANCE, contig: str = "contig", position: str = "pos") -> DataFrame:
    """``points`` with ``ref_contig, ref_pos, flipped, map_status``; positions are from 0.

    Of the chains that have a block over a point, the one of the best score (the first in its file on a tie) maps it:
    ``mapped``, or ``ambiguous`` if another puts it over ``tolerance`` bases elsewhere. Without any: ``unmapped`` and
    nulls. Pairs of a point and the blocks over it are never made: best rank and bounds of the places are aggregated
    by tiles of the blocks, a distinct point reads the tiles that hold it, and only the block that won is joined.
    """
    return _lift(points, _places(blocks), tolerance, contig, position)


def _places(blocks: DataFrame) -> DataFrame:
    """Blocks, stored, with ``_off``: a base p of theirs lies at _off + p where ``_plus``, else at _off - p."""
    plus = F.coalesce(F.col("q_strand") == "+", F.lit(False))
    off = F.when(plus, F.col("q_start") - F.col("t_start")).otherwise(F.col("q_end") - 1 + F.col("t_start"))
    kept = blocks.where(F.col("t_end") > F.col("t_start"))
    return stored(kept.select("t_name", "t_start", "t_end", "score", "file_order", "q_name", off.alias("_off"), plus.alias("_plus"), (F.col("q_strand") == "-").alias("_flip")), "blocks")


def _rank() -> Column:
    """Score (best first, null last) and order in the file as one number, as hash aggregates have no minimum of structs."""
    return F.coalesce(F.col("score"), F.lit(-5 * 10**18)).cast("decimal(19,0)") * F.lit(Decimal(-(2**64))) + (F.coalesce(F.col("file_order"), F.lit(2**63 - 1)).cast("decimal(19,0)") + F.lit(Decimal(2**63)))


def _lift(points: DataFrame, blocks: DataFrame, tolerance: int, contig: str, position: str) -> DataFrame:
    longest = blocks.agg(F.max(F.col("t_end") - F.col("t_start"))).first()[0] or 1
    top = longest.bit_length()
    p, at = F.col("_p"), F.col("_p").cast("long")
    plus, minus = F.when(F.col("_plus"), F.col("_off")), F.when(~F.col("_plus"), F.col("_off"))
    bounds = {"_lp": F.min(plus), "_hp": F.max(plus), "_lm": F.min(minus), "_hm": F.max(minus)}
    ranked = blocks.select("t_name", "t_start", "t_end", "_off", "_plus", _rank().alias("_r"))
    best = tiles(ranked, "t_start", "t_end").groupBy("t_name", "_j", "_i").agg(F.min("_r").alias("_r"), *[v.alias(k) for k, v in bounds.items()])
    distinct = points.select(F.col(contig).alias("_c"), F.col(position).alias("_p")).where(F.col(contig).isNotNull() & F.col(position).isNotNull()).distinct()
    probes = distinct.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_i", down(at, F.col("_j")))
    held = probes.join(best, (F.col("_c") == F.col("t_name")) & (probes["_j"] == best["_j"]) & (probes["_i"] == best["_i"]))
    one = held.groupBy("_c", "_p").agg(F.min("_r").alias("_r"), *[(F.min if k.startswith("_l") else F.max)(k).alias(k) for k in bounds])

    # The block that won, among those of its rank: filed where it begins on the level that fits it, so it ends in the same bin or the next.
    level = down(F.greatest(reach(F.col("t_end") - F.col("t_start")), F.lit(4)) + 2, F.lit(1))
    levels = F.sequence(F.lit(3), F.lit(max(3, (top + 2) // 2)))
    filed = blocks.withColumn("_w", _rank()).withColumn("_level", level).withColumn("_bin", down(F.col("t_start"), 2 * F.col("_level")))
    looked = one.withColumn("_plevel", F.explode(levels)).withColumn("_pbin", F.explode(F.array(down(at, 2 * F.col("_plevel")), down(at, 2 * F.col("_plevel")) - 1)))
    found = looked.join(filed, (F.col("_r") == F.col("_w")) & (F.col("_c") == F.col("t_name")) & (F.col("_plevel") == F.col("_level")) & (F.col("_pbin") == F.col("_bin")) & (p >= F.col("t_start")) & (p < F.col("t_end")))
    q = F.when(F.col("_plus"), F.col("_off") + p).otherwise(F.col("_off") - p)
    lo, hi = F.least(F.col("_lp") + p, F.col("_lm") - p), F.greatest(F.col("_hp") + p, F.col("_hm") - p)
    won = found.groupBy("_c", "_p").agg(F.min(F.struct(F.col("q_name").alias("name"), q.alias("q"), F.col("_flip").alias("flip"))).alias("b"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    far = F.greatest(F.col("hi") - F.col("b.q"), F.col("b.q") - F.col("lo")) > tolerance
    mapped = won.select("_c", "_p", F.col("b.name").alias("ref_contig"), F.col("b.q").alias("ref_pos"), F.col("b.flip").alias("flipped"), F.when(far, "ambiguous").otherwise("mapped").alias("_status"))
    out = points.join(mapped, F.col(contig).eqNullSafe(F.col("_c")) & F.col(position).eqNullSafe(F.col("_p")), "left")
    return out.select(*points.columns, "ref_contig", "ref_pos", "flipped", F.coalesce("_status", F.lit("unmapped")).alias("map_status"))


def lift_report(report: DataFrame, blocks: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Every row of a report of one haplotype with ``hg38_chr, hg38_pos, hg38_flipped, map_status``.

    The contig is what follows the last ``#`` of its name. ``start`` is from 1 and so is ``hg38_pos``; what maps is
    the target's leftmost base, and if a chain is reversed its rightmost one, which then is leftmost.
    """
    report, blocks = stored(report, "unlifted"), _places(blocks)
    bases = F.length(F.translate("target_aligned", "-", ""))
    ends = report.select("*", bare_contig(F.col("chromosome")).alias("_contig"), (F.col("start") - 1).alias("_left"), (F.col("start") - 2 + bases).alias("_right"))
    left = _lift(ends, blocks, tolerance, "_contig", "_left").withColumnsRenamed({"ref_contig": "_lc", "ref_pos": "_lp", "flipped": "_lf", "map_status": "_ls"})
    left = stored(left, "lifted")
    both = _lift(left, blocks, tolerance, "_contig", "_right")
    anchored = F.coalesce(F.col("_lf"), F.lit(False)) & (F.col("map_status") != "unmapped") & (F.col("ref_contig") == F.col("_lc"))
    return both.select(
        *report.columns,
        F.col("_lc").alias("hg38_chr"),
        (F.when(anchored, F.col("ref_pos")).otherwise(F.col("_lp")) + 1).alias("hg38_pos"),
        F.col("_lf").cast("int").alias("hg38_flipped"),
        F.col("_ls").alias("map_status"),
    )


def lift_statistics(lifted: DataFrame) -> DataFrame:
    """One row: ``mapped, ambiguous, unmapped``."""
    return lifted.agg(*[F.count_if(F.col("map_status") == s).alias(s) for s in ("mapped", "ambiguous", "unmapped")])
