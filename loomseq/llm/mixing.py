"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take from each source, for a list of sources that fits in memory (``target_table`` is for any number). Sources by code point, null last, weigh ``weights`` repeating and share all words; none gets over ``most`` times its own, and what is over is shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    own, total = dict(order), sum(n for _, n in order)
    full: set[str | None] = set()
    while True:
        left, weight = total - most * sum(own[s] for s in full), sum(w for s, w in weigh.items() if s not in full)
        over = {s for s, w in weigh.items() if s not in full and w * left > most * own[s] * weight}
        if not over:
            return {s: float(most * own[s]) if s in full else (w * left) / weight if weight else 0.0 for s, w in weigh.items()}
        full |= over


def offset(source: str | None, seed: str = SEED) -> float:
    """The one random number of a source, from 0 up to 1."""
    return int(hashlib.md5(f"{seed}|{'null' if source is None else 's' + source}".encode()).hexdigest()[:8], 16) / 2**32


def target_table(sums: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``targets`` and ``offset`` as a table, for any number of sources: ``source, source_size, target, u``, from ``sums`` (``source, source_size``, one row a source).

    Sources are numbered by range partitions, each counted and numbered on its own. A source is full if its share by
    weight is over ``most`` times its size. Which ones are depends on two sums alone, what is left to share and the
    weight it is shared by: the driver holds these two numbers, and sums again until no further source is full.
    """
    spark = sums.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = scratch.table(sums.select("source", "source_size").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources-ranged")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    numbered = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(before), "part")
    weight_of = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + F.col("k") - 1) % len(weights) + 1).cast("int"))
    table = scratch.table(numbered.select("source", "source_size", weight_of.cast("decimal(10,0)").alias("w"), (F.col("source_size").cast("decimal(20,0)") * most).alias("cap")), "sources")
    total, weight = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("w")).first())
    left = total

    def full(left: int, weight: int) -> Column:
        return F.col("w") * F.lit(Decimal(left)).cast("decimal(20,0)") > F.col("cap") * F.lit(Decimal(weight)).cast("decimal(14,0)")

    while weight:
        capped, rest = (int(x or 0) for x in table.agg(F.sum(F.when(full(left, weight), F.col("cap"))), F.sum(F.when(~full(left, weight), F.col("w")))).first())
        if (total - capped, rest) == (left, weight):
            break
        left, weight = total - capped, rest
    share = (F.col("w") * F.lit(Decimal(left)).cast("decimal(20,0)")).cast("double") / F.lit(float(weight)) if weight else F.lit(0.0)
    target = F.when(full(left, weight), F.col("cap").cast("double")).otherwise(share)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)
    return table.select("source", "source_size", target.alias("target"), u.alias("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    Within a source each document's expected copies are target / source_size. The documents stand in order of size
    and identifier, a prefix sum of expected copies runs along them from one random offset of the source, and a
    document is emitted once per integer that the sum crosses in it. Order by size makes neighbours alike, so that the
    words taken come near the target. No document is taken over ``most`` times. The sum is the rate times the rank:
    ranks come from range partitions, each counted and numbered on its own, so no source meets in one task. Reruns
    agree. Null text has size 0, null sources form one source, null or repeated identifiers are numbered in order.
    A source without words takes nothing. Sources may be as many as the documents: nothing about
    them is gathered. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    rows = scratch.table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = target_table(sums, scratch, weights, most, seed)
    order = ["source", "size", "doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.table(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    # One row per source and range at most: ranges are few, and each holds few sources or lies in one.
    before = counts.select("source", "part", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id")).cast("long"))
    # What a source's rows need is joined to its one row a range first, so a large source's rows stay dealt over ranges.
    each = before.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.*", "p.source_size", "p.target", "p.u")
    joined = ranked.alias("r").join(each.alias("b"), (F.col("r.part") == F.col("b.part")) & F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.*", "b.before", "b.source_size", "b.target", "b.u")
    rank = F.col("before") + F.col("k")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(F.col("u") + rate * rank) - F.floor(F.col("u") + rate * (rank - 1))).cast("long")
    copies = F.least(F.greatest(copies, F.lit(0)), F.lit(most)).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op6_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS own, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY (3.0 * own) / w, source) AS k FROM s),
c AS (SELECT *, coalesce(sum(3 * own) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight,
             (SELECT sum(own) FROM s)::BIGINT AS total FROM o),
f AS (SELECT coalesce(min(k), (SELECT max(k) FROM c)) AS k0 FROM c WHERE w * (total - capped) <= 3 * own * weight),
t AS (SELECT source, own, w, CASE WHEN k < k0 THEN (3 * own)::DOUBLE
             ELSE (w * (total - (SELECT capped FROM c WHERE k = k0)))::DOUBLE / (SELECT weight FROM c WHERE k = k0)::DOUBLE END AS target,
             (('0x' || substr(md5('mix-1|' || coalesce('s' || source, 'null')), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u
      FROM c, f),
r AS (SELECT d.doc_id, d.size, t.own AS source_size, t.target, t.u, CASE WHEN t.own > 0 THEN t.target / t.own::DOUBLE ELSE 0.0::DOUBLE END AS rate,
             (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id))::DOUBLE AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(u + rate * rank) - floor(u + rate * (rank - 1)))::BIGINT * size AS taken FROM r
"""
}
