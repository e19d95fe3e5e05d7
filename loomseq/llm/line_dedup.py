"""Line dedup by overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents, keyed_join

WINDOW = 3
_SEED = 1_000_003


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` (with ``_lines``) as a row per run of ``window`` consecutive lines: ``_pos, k1, k2``, the keys being 128 hash bits of its lines.

    Lines are hashed in a projection of their own: inside a lambda they would be hashed again for every window.
    """
    hashed = rows.where(F.size("_lines") >= window).select(
        *[c for c in rows.columns if c != "_lines"],
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h1"),
        F.transform("_lines", lambda x: F.xxhash64(F.lit(_SEED), x)).alias("_h2"),
    )

    def at(pos: Column) -> Column:
        return F.struct(
            pos.cast("long").alias("_pos"),
            F.xxhash64(*[F.get("_h1", pos + k) for k in range(window)]).alias("k1"),
            F.xxhash64(F.lit(_SEED), *[F.get("_h2", pos + k) for k in range(window)]).alias("k2"),
        )

    exploded = hashed.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.size("_h1") - window), at)).alias("w"))
    return exploded.select(*[c for c in rows.columns if c != "_lines"], "w.*")


def _merged(spans: DataFrame) -> DataFrame:
    """``_row, _spans, _removed`` from overlapping spans ``_row, a, b``: the covered lines as disjoint spans in order, in one sorted pass over each text's own."""
    order = Window.partitionBy("_row").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = island.groupBy("_row", "_island").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    return each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"), F.sum(F.col("last") - F.col("first") + 1).alias("_removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_removed, text`` (what remains), ``spans`` (removed, first and last line).

    A window of ``window`` lines (split at line feeds) that occurs more than once in the corpus stays where it occurs
    first, by (doc_id, text's MD5, line); every later occurrence is removed, lines covered by several windows once.
    Where a later occurrence overlaps the first in one text, the first's lines stay. So each distinct passage survives
    once. Rows are told apart by a stored number, so rows that share an identifier are texts of their own: of two that
    are equal in both, one stays. Null text is empty: one empty line. Texts of fewer lines than a window, and rows
    with a null identifier, stay whole. Work grows with a text's lines, however many are covered. Other columns are
    not read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    base = scratch.table(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), "base")
    lines = F.split("_text", "\n", -1)
    mark = F.conv(F.substring(F.md5("_text"), 1, 15), 16, 10).cast("long")  # 60 bits, which SQL can tell too
    places = scratch.table(_windows(base.where("doc_id is not null").select("doc_id", mark.alias("_mark"), "_row", lines.alias("_lines")), window), "places")
    place = F.struct("doc_id", "_mark", "_row", "_pos")
    repeated = scratch.table(places.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "repeated")
    later = keyed_join(places, repeated, ["k1", "k2"], "n", places.count()).where((F.col("_row") != F.col("first._row")) | (F.col("_pos") != F.col("first._pos")))
    start = F.when(F.col("_row") == F.col("first._row"), F.greatest("_pos", F.col("first._pos") + window)).otherwise(F.col("_pos"))
    covered = _merged(later.select("_row", start.alias("a"), (F.col("_pos") + window - 1).alias("b")))
    spans = F.coalesce("_spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))
    rows = base.join(covered, "_row", "left").select("doc_id", "_text", lines.alias("_lines"), spans.alias("spans"), F.coalesce("_removed", F.lit(0)).cast("long").alias("n_removed"))

    def between(i: Column) -> Column:
        """The lines after span i - 1 and before span i."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["last"] + 1).cast("int")
        end = F.when(i == F.size("spans"), F.size("_lines")).otherwise(F.get("spans", i)["first"]).cast("int")
        return F.slice("_lines", begin + 1, end - begin)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("spans")), between)), "\n")
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), "n_removed", F.when(F.col("n_removed") == 0, F.col("_text")).otherwise(kept).alias("text"), "spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op5_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS mark, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT r, doc_id, mark, p::BIGINT AS pos, lines[p+1] AS a, lines[p+2] AS b, lines[p+3] AS c
      FROM (SELECT *, unnest(range(0, greatest(len(lines) - 2, 0))) AS p FROM d WHERE doc_id IS NOT NULL)),
g AS (SELECT *, count(*) OVER k AS n, first_value(r) OVER (k ORDER BY doc_id, mark, r, pos) AS fr, first_value(pos) OVER (k ORDER BY doc_id, mark, r, pos) AS fp
      FROM w WINDOW k AS (PARTITION BY a, b, c)),
cov AS (SELECT DISTINCT r, unnest(range(CASE WHEN r = fr THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS gone
        FROM g WHERE n > 1 AND NOT (r = fr AND pos = fp)),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM d)
SELECT l.doc_id, count(*) AS n_lines, count(cov.gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE cov.gone IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN cov ON l.r = cov.r AND l.i = cov.gone GROUP BY l.r, l.doc_id
"""
}
