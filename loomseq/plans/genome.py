"""Queries of the off-target search and its relational work over the driver's tables, with their SQL.

The tables hold no genomes, so contigs are made of documents' letters (see ``pseudo_contigs``), features of orders,
chains of orders and their lines, and haplotype reports of lines. Every query reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import mutation_score, n_count, pam_variants_table, reverse_complement
from loomseq.functions.cfd import PAM_WEIGHTS, WEIGHTS_BY_RULE
from loomseq.operators.align import Thresholds, align, hamming
from loomseq.operators.annotate import annotate
from loomseq.operators.cluster import partition_report, single_linkage, tasks_for
from loomseq.operators.liftover import lift_points
from loomseq.operators.merge import merge_assemblies, sample_table
from loomseq.operators.report import rendered
from loomseq.operators.scan import expand, protospacer, scan_windows, window_groups, window_statistics
from loomseq.operators.stored import stored
from loomseq.search import search
from loomseq.sources.assembly import match_manifest
from loomseq.sources.bed import terms
from loomseq.sources.chain import blocks_from_steps, ranked_chains
from loomseq.sources.fasta import pseudo_contigs
from loomseq.streaming.sessions import stream_clusters

GUIDES = ["CGAGCCTCTGCCAACATACA", "CTGTTAGGCGTCTAGCTTTA"]
PAM = "NGG"
MM = 8
_N = len(GUIDES[0])


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_contigs(_t(spark, sf_dir, "documents"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_windows(_contigs(spark, sf_dir), PAM, _N + len(PAM))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_contigs(spark, sf_dir), GUIDES, PAM, Thresholds(MM), weights=WEIGHTS_BY_RULE)  # a table of weights made for trials, which SQL can compute too


# --- scan, alignment, report ---


def iupac_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    return _contigs(spark, sf_dir).select("contig", F.md5(reverse_complement(seq)).alias("revcomp_md5"), F.length(seq).cast("long").alias("bases"), n_count(seq).cast("long").alias("n_bases"), mutation_score(seq).alias("mutation_score"))


def pam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


def pam_scan_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_windows(_contigs(spark, sf_dir), "TTTV", 24, upstream=True)


def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_groups(protospacer(_windows(spark, sf_dir), len(PAM)))


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_statistics(protospacer(_windows(spark, sf_dir), len(PAM)))


def align_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = protospacer(_windows(spark, sf_dir), len(PAM)).select("protospacer").distinct()
    return align(distinct, GUIDES, Thresholds(MM)).select("guide", "protospacer", "ops", "rseq", "mm")


def hamming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = protospacer(_windows(spark, sf_dir), len(PAM)).select("protospacer").distinct()
    return hamming(distinct, GUIDES[0], max_mm=MM)


def occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = stored(protospacer(_windows(spark, sf_dir), len(PAM)), "windows")
    return expand(windows, align(windows.select("protospacer").distinct(), GUIDES, Thresholds(MM))).select("contig", "strand", "pos", "pam", "guide", "mm")


def align_bulges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script with up to 4 mismatches, one DNA and one RNA bulge, of each distinct protospacer."""
    caps = Thresholds(4, 1, 1)
    windows = scan_windows(_contigs(spark, sf_dir), PAM, _N + len(PAM) + caps.pad)
    return align(protospacer(windows, len(PAM)).select("protospacer").distinct(), GUIDES, caps)


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).withColumn("CFD_score", F.round(F.col("CFD_score").cast("double"), 4))


def search_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(_report(spark, sf_dir))


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hundred hits of a report: a sort whose limit makes it a top-k in each task."""
    return _report(spark, sf_dir).select("chromosome", "start", "strand", "target_aligned", "edit_distance").orderBy("edit_distance", "chromosome", F.when(F.col("strand") == "+", 1).otherwise(0), "start", "target_aligned").limit(100)


def _kinds(spark: SparkSession, both: tuple[DataFrame, DataFrame]) -> DataFrame:
    primary, alternative = both
    return primary.withColumn("kind", F.lit("primary")).unionByName(alternative.withColumn("kind", F.lit("alternative")))


def primary_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["chromosome", "start", "strand", "sgRNA_aligned", "target_aligned", "edit_distance", "kind"]
    return _kinds(spark, partition_report(_report(spark, sf_dir), 3)).select(*cols)


def search_primary_bulges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both guides with bulges, scored, and the primary hit of each cluster."""
    found = search(_contigs(spark, sf_dir), GUIDES, PAM, Thresholds(4, 1, 1), weights=WEIGHTS_BY_RULE)
    return partition_report(found, 3, ["edit-dist", "cfd"])[0]


def pam_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pam_variants_table(spark, "NNGRRT")


# --- clusters ---


def cluster_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = stored(_windows(spark, sf_dir).select("contig", "strand", "pos"), "windows")
    tasks = tasks_for(windows)
    clustered = single_linkage(windows, ["contig", "strand"], "pos", 3, unique=True, tasks=tasks)  # a strand has one window at a position
    return clustered.repartition(tasks, "contig", "strand", "cluster_start").groupBy("contig", "strand", "cluster_start", "cluster_no").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("cluster_end"))


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    tasks = tasks_for(micros)
    clustered = single_linkage(micros.groupBy("user_id", "at").agg(F.count(F.lit(1)).alias("n")), ["user_id"], "at", 600_000_000, 1 << 42, unique=True, tasks=tasks)
    return clustered.repartition(tasks, "user_id", "cluster_start").groupBy("user_id", "cluster_start").agg(F.max("at").alias("cluster_end"), F.sum("n").alias("n"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs by session windows, the form that also works on a stream."""
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = stream_clusters(events, ["user_id"], "ts", "600 seconds", "1 hour")
    return runs.select("user_id", F.unix_micros("first").alias("cluster_start"), F.unix_micros("last").alias("cluster_end"), "n")


# --- annotation ---


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 3000
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("chrom"), start.alias("bed_start"), (start + 20 + F.col("o_orderkey") % 400).alias("bed_end"), F.col("o_orderpriority").alias("term"), F.col("o_orderkey").alias("at"))


def term_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, 1 << i) for i, t in enumerate(terms(_features(spark, sf_dir)))], "term string, mask long")


def annotate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir).select(F.col("contig").alias("chromosome"), (F.col("pos") + 1).alias("start"), "strand", F.col("window").alias("target_aligned"))
    return annotate(windows, _features(spark, sf_dir), "annotation_0", len(PAM)).select("chromosome", "start", "strand", "annotation_0")


# --- liftover ---


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        k.alias("chain_id"), F.floor("o_totalprice").cast("long").alias("score"), F.concat(F.lit("c"), (k % 50).cast("string")).alias("t_name"), (k * 37 % 20000).alias("t_start"), F.concat(F.lit("r"), (k % 7).cast("string")).alias("q_name"),
        F.lit(100000).cast("long").alias("q_size"), (k * 53 % 20000).alias("q_start"), F.when(F.col("o_orderstatus") == "O", "-").otherwise("+").alias("q_strand"), k.alias("file_order"),
    )


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    per_step = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chain_id"), n.alias("step_no")).agg(F.max(F.floor("l_quantity")).cast("long").alias("size"))
    return per_step.select("chain_id", "step_no", "size", F.col("step_no").alias("dt"), (F.col("step_no") * 2).alias("dq"))


def chain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_steps(_chains(spark, sf_dir), _steps(spark, sf_dir))


def chain_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_chains(chain_blocks(spark, sf_dir)).select("t_name", "chain_id", "score", "rank")


def liftover_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("contig"), (F.col("event_id") * 7919 % 20300).alias("pos"))
    return lift_points(points, chain_blocks(spark, sf_dir))


# --- merge ---

_LAYOUT = {f"HG{i}": [1, 2] for i in range(5)}


def _lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    sample = F.concat(F.lit("HG"), (F.col("l_suppkey") % 5).cast("string"))
    hap = (F.col("l_linenumber") % 2 + 1).cast("int")
    plus = F.col("l_returnflag") != "R"
    mm = (order % 5).cast("int")
    mapped = F.col("l_linestatus") != "O"
    null = F.lit(None).cast("float")

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    return _t(spark, sf_dir, "lineitem").select(
        sample.alias("sample"), hap.alias("hap"), text(sample, "#", hap, "#c", part % 7).alias("chromosome"), (part * 13 % 5000 + 1).alias("start"), F.when(plus, "+").otherwise("-").alias("strand"),
        F.lit("GGNGG").alias("sgRNA_aligned"), text("T", part % 3).alias("target_aligned"), mm.alias("mismatches"), F.lit(0).alias("dna_bulges"), F.lit(0).alias("rna_bulges"), F.lit("X").alias("bulge_type"), mm.alias("edit_distance"),
        null.alias("CFD_score"), null.alias("CRISTA_score"), null.alias("Elevation_score"), null.alias("aggregate_score"), F.call_function("shiftleft", F.lit(1).cast("long"), (order % 4).cast("int")).alias("annotation"),
        F.when(mapped, text("chr", part % 7)).alias("hg38_chr"), F.when(mapped, part * 13 % 5000 + 101).alias("hg38_pos"), F.when(mapped, (part % 2).cast("int")).alias("hg38_flipped"), F.when(~mapped, "unmapped").when(part % 11 == 0, "ambiguous").otherwise("mapped").alias("map_status"),
    )


def merge_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_assemblies(_lifted(spark, sf_dir), sample_table(spark, _LAYOUT), 3)
    return merged.select("chromosome", "start", "strand", "target_aligned", "mismatches", "annotation", "samples", "map_status")


def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keyed(name: str, key: str, file: str, nation: str) -> DataFrame:
        k = F.col(key)
        return _t(spark, sf_dir, name).select(F.concat(F.lit("S"), F.col(nation).cast("string")).alias("sample"), (k % 97).cast("int").alias("hap"), F.concat(F.lit(f"{file}/"), F.lpad(k.cast("string"), 9, "0")).alias(file))

    return match_manifest(keyed("customer", "c_custkey", "fasta", "c_nationkey"), keyed("supplier", "s_suppkey", "chain", "s_nationkey"))


QUERIES = {
    f.__name__: f
    for f in (
        iupac_revcomp, pam_variants, pam_scan, pam_scan_upstream, window_dedup, window_counts, align_mm, hamming_filter, occurrence_join, align_bulges, search_report, search_rendered, search_topk, primary_alternative,
        search_primary_bulges, cluster_windows, event_clusters, event_sessions, term_bits, annotate_overlap, chain_blocks, chain_ranks, liftover_points, merge_haplotypes, manifest_match,
    )
}

# --- SQL ---

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_C = f"c AS (SELECT doc_id::VARCHAR AS contig, translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{_LETTERS}', '{''.join('ACGT'[i % 4] for i in range(52))}') AS seq FROM documents WHERE text IS NOT NULL)"


def _scan_sql(size: int, plus: str, minus: str) -> str:
    return f"""{_C},
spots AS (SELECT contig, seq, unnest(range(1, length(seq) - {size - 2}))::BIGINT AS i FROM c),
w AS (SELECT contig, '+' AS strand, i - 1 AS pos, substr(seq, i, {size}) AS "window" FROM spots WHERE {plus}
      UNION ALL SELECT contig, '-', i - 1, reverse(translate(substr(seq, i, {size}), 'ACGT', 'TGCA')) FROM spots WHERE {minus})"""


_W = _scan_sql(23, "substr(seq, i + 21, 2) = 'GG'", "substr(seq, i, 2) = 'CC'")
_G = "g(guide) AS (VALUES " + ", ".join(f"('{g}')" for g in GUIDES) + ")"


def _each(value: str) -> str:
    return f"[{value} for k in range(1, {_N + 1})]"


_SAME = f"substr({{p}}, k::BIGINT, 1) = substr(guide, k::BIGINT, 1)"  # noqa: F541


def _mm(p: str) -> str:
    return f"list_sum({_each(f'CASE WHEN {_SAME.format(p=p)} THEN 0 ELSE 1 END')})::INT"


def _rseq(p: str) -> str:
    return f"array_to_string({_each(f'CASE WHEN {_SAME.format(p=p)} THEN substr({p}, k::BIGINT, 1) ELSE lower(substr({p}, k::BIGINT, 1)) END')}, '')"


_PURINES = "(substr(guide, k::BIGINT, 1) IN ('A', 'G')) = (substr(\"window\", k::BIGINT, 1) IN ('A', 'G'))"
_CFD = f"(pam_weight * list_product({_each(f'CASE WHEN {_SAME.format(p=chr(34) + "window" + chr(34))} THEN 1.0::DOUBLE ELSE round((CASE WHEN {_PURINES} THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) * (1 - (k - 1)::DOUBLE / 25), 6) END')}))::FLOAT"
_R = f"""{_W}, {_G},
pw(two, pam_weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PAM_WEIGHTS.items())}),
m AS (SELECT *, {_mm('"window"')} AS mm FROM w, g),
r AS (SELECT contig AS chromosome, pos + 1 AS start, strand, guide || 'NGG' AS "sgRNA_aligned", {_rseq('"window"')} || substr("window", 21, 3) AS target_aligned, mm AS mismatches,
             0 AS dna_bulges, 0 AS rna_bulges, 'X' AS bulge_type, mm AS edit_distance, {_CFD} AS "CFD_score", NULL::FLOAT AS "CRISTA_score", NULL::FLOAT AS "Elevation_score", NULL::FLOAT AS aggregate_score
      FROM m JOIN pw ON pw.two = substr("window", 22, 2) WHERE mm <= {MM})"""

# All scripts with up to 4 mismatches, one DNA and one RNA bulge: each step of the recursion takes one more column.
_BULGES = f"""{_scan_sql(24, "substr(seq, i + 22, 2) = 'GG'", "substr(seq, i, 2) = 'CC'")}, {_G},
d AS (SELECT DISTINCT substr("window", 1, 21) AS protospacer FROM w),
step(op) AS (VALUES ('M'), ('I'), ('D')),
a(guide, protospacer, "offset", i, j, mm, bdna, brna, ops, rguide, rseq) AS (
  SELECT guide, protospacer, o::INT, 0, o::INT, 0, 0, 0, '', '', '' FROM d, g, range(0, 3) t(o)
  UNION ALL
  SELECT guide, protospacer, "offset", i2, j2, mm2, bdna2, brna2, ops || CASE WHEN op <> 'M' THEN op WHEN mm2 > mm THEN 'X' ELSE '=' END,
         rguide || CASE WHEN op = 'I' THEN '-' ELSE substr(guide, i2, 1) END, rseq || CASE WHEN op = 'D' THEN '-' WHEN mm2 > mm THEN lower(substr(protospacer, j2, 1)) ELSE substr(protospacer, j2, 1) END
  FROM (SELECT *, mm + (op = 'M' AND substr(guide, i2, 1) <> substr(protospacer, j2, 1))::INT AS mm2
        FROM (SELECT a.*, op, i + (op <> 'I')::INT AS i2, j + (op <> 'D')::INT AS j2, bdna + (op = 'I')::INT AS bdna2, brna + (op = 'D')::INT AS brna2 FROM a, step WHERE NOT (i = 20 AND j = 21) AND (op <> 'I' OR i > 0))
        WHERE i2 <= 20 AND j2 <= 21 AND bdna2 <= 1 AND brna2 <= 1 AND i2 + 1 - j2 BETWEEN brna2 - 1 AND 1 - bdna2)
  WHERE mm2 <= 4),
al AS (SELECT guide, protospacer, "offset", ops, rguide, rseq, mm, bdna, brna FROM a WHERE i = 20 AND j = 21)"""
_BULGE_CFD = """(pam_weight * list_product([CASE WHEN substr(rguide, k::BIGINT, 1) IN ('-', upper(substr(rseq, k::BIGINT, 1))) OR substr(rseq, k::BIGINT, 1) = '-' THEN 1.0::DOUBLE
  ELSE round((CASE WHEN (substr(rguide, k::BIGINT, 1) IN ('A', 'G')) = (upper(substr(rseq, k::BIGINT, 1)) IN ('A', 'G')) THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END) * (1 - (k - 1)::DOUBLE / 25), 6) END for k in range(1, 21)]))::FLOAT"""
_BULGE_REPORT = f"""{_BULGES},
pw(two, pam_weight) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in PAM_WEIGHTS.items())}),
r AS (SELECT contig AS chromosome, CASE WHEN strand = '+' THEN pos + "offset" ELSE pos END + 1 AS start, strand, rguide || 'NGG' AS "sgRNA_aligned", rseq || substr("window", 22, 3) AS target_aligned, mm AS mismatches,
             bdna AS dna_bulges, brna AS rna_bulges, CASE WHEN bdna > 0 AND brna > 0 THEN 'DNA/RNA' WHEN bdna > 0 THEN 'DNA' WHEN brna > 0 THEN 'RNA' ELSE 'X' END AS bulge_type, mm + bdna + brna AS edit_distance, {_BULGE_CFD} AS "CFD_score"
      FROM w JOIN al ON al.protospacer = substr("window", 1, 21) JOIN pw ON pw.two = substr("window", 23, 2)),
f AS (SELECT chromosome, strand, start, CASE WHEN start - lag(start) OVER (PARTITION BY chromosome, strand ORDER BY start) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT chromosome, strand, start FROM r)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY chromosome, strand ORDER BY start) AS no FROM f),
o AS (SELECT r.*, row_number() OVER (PARTITION BY chromosome, strand, no ORDER BY edit_distance, "CFD_score" DESC NULLS LAST, target_aligned, start, "sgRNA_aligned", mismatches, dna_bulges, rna_bulges) AS rn FROM r JOIN k USING (chromosome, strand, start))"""

_BLOCKS = """s AS (SELECT l_orderkey AS chain_id, l_linenumber::BIGINT AS step_no, max(floor(l_quantity))::BIGINT AS size FROM lineitem GROUP BY ALL),
n AS (SELECT *, coalesce(sum(size + step_no) OVER b, 0)::BIGINT AS dt, coalesce(sum(size + 2 * step_no) OVER b, 0)::BIGINT AS dq FROM s
      WINDOW b AS (PARTITION BY chain_id ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT o_orderkey AS chain_id, floor(o_totalprice)::BIGINT AS score, 'c' || (o_orderkey % 50) AS t_name, o_orderkey * 37 % 20000 AS t0, 'r' || (o_orderkey % 7) AS q_name, o_orderkey * 53 % 20000 AS q0,
             CASE WHEN o_orderstatus = 'O' THEN '-' ELSE '+' END AS q_strand, o_orderkey AS file_order FROM orders),
p AS (SELECT h.*, t0 + dt AS t_start, size, CASE WHEN q_strand = '+' THEN q0 + dq ELSE 100000 - (q0 + dq + size) END AS q_start FROM n JOIN h USING (chain_id)),
b AS (SELECT chain_id, score, t_name, t_start, t_start + size AS t_end, q_name, q_start, q_start + size AS q_end, q_strand, file_order FROM p)"""

_ISLANDS = """e AS (SELECT user_id, epoch_us(ts) AS tick FROM events),
f AS (SELECT *, CASE WHEN tick - lag(tick) OVER (PARTITION BY user_id ORDER BY tick) <= 600000000 THEN 0 ELSE 1 END AS fresh FROM e),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY tick) AS no FROM f)
SELECT user_id, min(tick) AS cluster_start, max(tick) AS cluster_end, count(*) AS n FROM k GROUP BY user_id, no"""

_BED = "bed AS (SELECT o_custkey::VARCHAR AS chrom, o_orderkey % 3000 AS a, o_orderkey % 3000 + 20 + o_orderkey % 400 AS z, o_orderpriority AS term FROM orders), tb AS (SELECT o_orderpriority AS term, (1 << (row_number() OVER (ORDER BY min(o_orderkey)) - 1)::INT)::BIGINT AS mask FROM orders GROUP BY 1)"


def _merge_level(source: str, name: str, keys: str, mask: str) -> str:
    """One level of clusters and their best rows, as CTEs that end in ``name``."""
    part = f"{keys}space, chromosome, strand, target_aligned"
    return f"""{name}_f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY {part} ORDER BY start) <= 3 THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_k AS (SELECT *, sum(fresh) OVER (PARTITION BY {part} ORDER BY start) AS no FROM {name}_f),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY {part}, no ORDER BY mismatches, start, map_status) AS rn, bit_or(annotation) OVER (PARTITION BY {part}, no) AS ann, {mask} FROM {name}_k)"""


_MERGE = f"""l AS (SELECT 'HG' || (l_suppkey % 5) AS sample, l_linenumber % 2 + 1 AS hap, l_linestatus <> 'O' AS mapped, l_partkey AS p, l_orderkey % 5 AS mismatches, (1 << (l_orderkey % 4)::INT)::BIGINT AS annotation,
             CASE WHEN l_returnflag <> 'R' THEN '+' ELSE '-' END AS own FROM lineitem),
x AS (SELECT sample, mapped::INT AS space, CASE WHEN mapped THEN 'chr' || (p % 7) ELSE sample || '#' || hap || '#c' || (p % 7) END AS chromosome, CASE WHEN mapped THEN p * 13 % 5000 + 101 ELSE p * 13 % 5000 + 1 END AS start,
             CASE WHEN mapped AND p % 2 = 1 THEN CASE own WHEN '+' THEN '-' ELSE '+' END ELSE own END AS strand, 'T' || (p % 3) AS target_aligned, mismatches, annotation,
             CASE WHEN NOT mapped THEN 'unmapped' WHEN p % 11 = 0 THEN 'ambiguous' ELSE 'mapped' END AS map_status, (1 << (hap - 1)::INT)::BIGINT AS mask FROM l),
{_merge_level("x", "a", "sample, ", "bit_or(mask) OVER (PARTITION BY sample, space, chromosome, strand, target_aligned, no) AS m")},
y AS (SELECT sample, space, chromosome, start, strand, target_aligned, mismatches, ann AS annotation, map_status, m AS mask FROM a_o WHERE rn = 1),
{_merge_level("y", "z", "", "0 AS m")},
pres AS (SELECT space, chromosome, strand, target_aligned, no, sample, bit_or(mask) AS mask FROM z_k GROUP BY ALL),
txt AS (SELECT space, chromosome, strand, target_aligned, no, string_agg(sample || ':' || (mask & 1) || '|' || ((mask >> 1) & 1), ',' ORDER BY sample) AS samples FROM pres GROUP BY ALL)"""

ORACLE_SQL = {
    "iupac_revcomp": f"WITH {_C} SELECT contig, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS revcomp_md5, length(seq) AS bases, 0::BIGINT AS n_bases, length(seq) AS mutation_score FROM c",
    "pam_variants": "WITH b(x, i) AS (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)), r(x, i) AS (VALUES ('A', 0), ('G', 1)) SELECT (((p.i * 4 + q.i) * 2 + s.i) * 2 + t.i)::BIGINT AS pam_id, p.x || q.x || 'G' || s.x || t.x || 'T' AS variant FROM b p, b q, r s, r t",
    "pam_scan": f'WITH {_W} SELECT contig, strand, pos, "window", substr("window", 21, 3) AS pam FROM w',
    "pam_scan_upstream": f"""WITH {_scan_sql(24, "substr(seq, i, 3) = 'TTT' AND substr(seq, i + 3, 1) <> 'T'", "substr(seq, i + 21, 3) = 'AAA' AND substr(seq, i + 20, 1) <> 'A'")} SELECT contig, strand, pos, "window", substr("window", 1, 4) AS pam FROM w""",
    "window_dedup": f'WITH {_W} SELECT substr("window", 1, 20) AS protospacer, count(*) AS n FROM w GROUP BY 1',
    "window_counts": f'WITH {_W} SELECT count(*) AS hits, count(DISTINCT substr("window", 1, 20)) AS unique_windows FROM w',
    "align_mm": f"""WITH {_W}, {_G}, d AS (SELECT DISTINCT substr("window", 1, 20) AS protospacer FROM w), m AS (SELECT *, {_mm("protospacer")} AS mm FROM d, g)
SELECT guide, protospacer, array_to_string({_each(f"CASE WHEN {_SAME.format(p='protospacer')} THEN '=' ELSE 'X' END")}, '') AS ops, {_rseq("protospacer")} AS rseq, mm FROM m WHERE mm <= {MM}""",
    "hamming_filter": f"""WITH {_W}, d AS (SELECT DISTINCT substr("window", 1, 20) AS protospacer FROM w), m AS (SELECT protospacer, {_mm("protospacer")} AS mm FROM (SELECT *, '{GUIDES[0]}' AS guide FROM d)) SELECT protospacer, mm FROM m WHERE mm <= {MM}""",
    "occurrence_join": f'WITH {_W}, {_G}, m AS (SELECT *, {_mm(chr(34) + "window" + chr(34))} AS mm FROM w, g) SELECT contig, strand, pos, substr("window", 21, 3) AS pam, guide, mm FROM m WHERE mm <= {MM}',
    "align_bulges": f"WITH RECURSIVE {_BULGES} SELECT * FROM al",
    "search_primary_bulges": f"""WITH RECURSIVE {_BULGE_REPORT} SELECT chromosome, start::BIGINT AS start, strand, "sgRNA_aligned", target_aligned, mismatches, dna_bulges, rna_bulges, bulge_type, edit_distance,
"CFD_score", NULL::FLOAT AS "CRISTA_score", NULL::FLOAT AS "Elevation_score", NULL::FLOAT AS aggregate_score FROM o WHERE rn = 1""",
    "search_report": f'WITH {_R} SELECT * REPLACE (round("CFD_score"::DOUBLE, 4) AS "CFD_score") FROM r',
    "search_rendered": f"""WITH {_R} SELECT chromosome, start::VARCHAR AS start, strand, "sgRNA_aligned", target_aligned, mismatches::VARCHAR AS mismatches, '0' AS dna_bulges, '0' AS rna_bulges, bulge_type, edit_distance::VARCHAR AS edit_distance,
printf('%.2f', "CFD_score"::DOUBLE) AS "CFD_score", 'NA' AS "CRISTA_score", 'NA' AS "Elevation_score", 'NA' AS aggregate_score FROM r""",
    "search_topk": f"WITH {_R} SELECT chromosome, start, strand, target_aligned, edit_distance FROM r ORDER BY edit_distance, chromosome, strand = '+', start, target_aligned LIMIT 100",
    "primary_alternative": f"""WITH {_R}, f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY chromosome, strand ORDER BY start) <= 3 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY chromosome, strand ORDER BY start, "sgRNA_aligned" ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT DISTINCT * FROM f)),
p AS (SELECT r.*, max(n.no) AS no FROM r JOIN (SELECT chromosome, strand, start, max(no) AS no FROM k GROUP BY ALL) n USING (chromosome, strand, start) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY chromosome, strand, no ORDER BY edit_distance, target_aligned, start, "sgRNA_aligned") AS rn FROM p)
SELECT chromosome, start, strand, "sgRNA_aligned", target_aligned, edit_distance, CASE WHEN rn = 1 THEN 'primary' ELSE 'alternative' END AS kind FROM o""",
    "cluster_windows": f"""WITH {_W}, f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig, strand ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS fresh FROM w),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, strand ORDER BY pos) AS no FROM f)
SELECT contig, strand, min(pos) AS cluster_start, (no - 1)::BIGINT AS cluster_no, count(*) AS n, max(pos) AS cluster_end FROM k GROUP BY contig, strand, no""",
    "event_clusters": f"WITH {_ISLANDS}",
    "event_sessions": f"WITH {_ISLANDS}",
    "term_bits": f"WITH {_BED} SELECT term, mask FROM tb",
    "annotate_overlap": f"""WITH {_W}, {_BED}, d AS (SELECT DISTINCT contig, pos FROM w),
o AS (SELECT contig, pos, string_agg(term, ',' ORDER BY mask) AS annotation_0 FROM (SELECT DISTINCT d.contig, d.pos, bed.term, tb.mask FROM d JOIN bed ON bed.chrom = d.contig AND bed.a < d.pos + 23 AND bed.z > d.pos JOIN tb USING (term)) GROUP BY ALL)
SELECT contig AS chromosome, pos + 1 AS start, strand, annotation_0 FROM w LEFT JOIN o USING (contig, pos)""",
    "chain_blocks": f"WITH {_BLOCKS} SELECT * FROM b",
    "chain_ranks": f'WITH {_BLOCKS} SELECT t_name, chain_id, score, (row_number() OVER (PARTITION BY t_name ORDER BY score DESC, file_order))::INT AS "rank" FROM (SELECT DISTINCT t_name, chain_id, score, file_order FROM b)',
    "liftover_points": f"""WITH {_BLOCKS}, pt AS (SELECT event_id, 'c' || (user_id % 50) AS contig, event_id * 7919 % 20300 AS pos FROM events),
hit AS (SELECT event_id, score, file_order, q_name, q_strand, CASE WHEN q_strand = '+' THEN q_start + pos - t_start ELSE q_end - 1 - (pos - t_start) END AS q FROM pt JOIN b ON b.t_name = pt.contig AND pos >= t_start AND pos < t_end),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, file_order) AS rn, min(q) OVER (PARTITION BY event_id) AS lo, max(q) OVER (PARTITION BY event_id) AS hi FROM hit)
SELECT event_id, contig, pos, q_name AS ref_contig, q AS ref_pos, q_strand = '-' AS flipped, CASE WHEN rn IS NULL THEN 'unmapped' WHEN greatest(hi - q, q - lo) > 10 THEN 'ambiguous' ELSE 'mapped' END AS map_status
FROM pt LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING (event_id)""",
    "merge_haplotypes": f"""WITH {_MERGE} SELECT z_o.chromosome, z_o.start, z_o.strand, z_o.target_aligned, z_o.mismatches::INT AS mismatches, z_o.ann AS annotation, samples, map_status
FROM z_o JOIN txt ON txt.space = z_o.space AND txt.chromosome = z_o.chromosome AND txt.strand = z_o.strand AND txt.target_aligned = z_o.target_aligned AND txt.no = z_o.no WHERE rn = 1""",
    "manifest_match": """WITH f AS (SELECT 'S' || c_nationkey AS sample, (c_custkey % 97)::INT AS hap, min('fasta/' || lpad(c_custkey::VARCHAR, 9, '0')) AS fasta, count(*) AS nf FROM customer GROUP BY ALL),
c AS (SELECT 'S' || s_nationkey AS sample, (s_suppkey % 97)::INT AS hap, min('chain/' || lpad(s_suppkey::VARCHAR, 9, '0')) AS chain, count(*) AS nc FROM supplier GROUP BY ALL)
SELECT sample, hap, fasta, chain, CASE WHEN fasta IS NULL THEN 'no FASTA' WHEN chain IS NULL THEN 'no chain' WHEN nf > 1 THEN 'several FASTA files' WHEN nc > 1 THEN 'several chains' END AS problem FROM f FULL JOIN c USING (sample, hap)""",
}
