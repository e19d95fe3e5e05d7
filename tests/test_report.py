
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq import cli
from loomseq.functions.cfd import PAM_WEIGHTS, WEIGHTS_BY_RULE, cfd, parse_weights, read_weights, weights_table
from loomseq.functions.alphabet import reverse_complement_text
from loomseq.operators.align import Thresholds
from loomseq.operators.annotate import annotate, annotate_all, fetch_lines
from loomseq.operators import cluster
from loomseq.operators.cluster import parse_criteria, partition_report, partition_statistics, single_linkage
from loomseq.operators.intervals import overlap_join, point_join
from loomseq.operators.report import read_report, rendered, write_report
from loomseq.plans.genome import cluster_windows, event_clusters, pam_scan
from loomseq.schemas import REPORT, report_schema
from loomseq.search import search, search_reference
from loomseq.sources.bed import read_bed, read_gff, terms
from loomseq.sources.fasta import check_contigs, contig_ids, contig_labels, fetch, guides, read_fasta, read_guides, statistics

FIXTURE = [
    ("chr1", 100, "+", "TARGETA", 2, 0, 0, "X", 2, "EX1", None),
    ("chr1", 102, "+", "TARGETB", 1, 1, 0, "DNA", 2, None, None),
    ("chr1", 101, "-", "TARGETC", 0, 0, 0, "X", 0, None, "REG1"),
    ("chr1", 200, "+", "TARGETD", 3, 0, 0, "X", 3, None, None),
    ("chr2", 100, "+", "TARGETE", 1, 0, 0, "X", 1, None, None),
]


def frame(spark, rows=FIXTURE, cfd=None):
    full = [(*r[:3], "GUIDE", *r[3:9], (cfd or [None] * len(rows))[i], None, None, None, *r[9:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, report_schema(["gene", "regulatory"]))


def targets(rows):
    return [r["target_aligned"] for r in rows.collect()]


def test_partition(spark):
    primary, alternative = partition_report(frame(spark), 3)
    assert sorted(targets(primary)) == ["TARGETA", "TARGETC", "TARGETD", "TARGETE"] and targets(alternative) == ["TARGETB"]
    assert tuple(partition_statistics(frame(spark)).first()) == (4, 4, 1)
    empty = frame(spark).limit(0)
    assert [x.count() for x in partition_report(empty)] == [0, 0] and tuple(partition_statistics(empty).first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        partition_report(empty, 0)


@pytest.mark.parametrize("starts, gap, n", [((100, 103), 3, 1), ((100, 104), 3, 2), ((100, 103, 106), 3, 1), ((1, 1, 1), 3, 1)])
def test_gaps(spark, starts, gap, n):
    rows = spark.createDataFrame([("c", s) for s in starts], "contig string, start long")
    got = single_linkage(rows, ["contig"], "start", gap)
    assert got.count() == len(starts) and got.select("cluster_start").distinct().count() == n


@pytest.mark.parametrize("width", [1, 8, 1 << 20])
def test_linkage_over_bins(spark, width):
    rng = np.random.default_rng(width)
    rows = [(k, int(p)) for k in ("a", None, "b") for p in rng.integers(0, 400, 90)] + [("a", None)]
    got = single_linkage(spark.createDataFrame(rows, "k string, p long"), ["k"], "p", 3, width).collect()
    assert len(got) == len(rows)
    for k in ("a", None, "b"):
        own = sorted({p for kk, p in rows if kk == k and p is not None})
        want, start, no = {}, None, -1
        for i, p in enumerate(own):
            if i == 0 or p - own[i - 1] > 3:
                start, no = p, no + 1
            want[p] = (start, no)
        assert all((r["cluster_start"], r["cluster_no"]) == want[r["p"]] for r in got if r["k"] == k and r["p"] is not None)
    assert [r["cluster_start"] for r in got if r["p"] is None] == [None]


@pytest.mark.parametrize("width", [1, 16, 1 << 20])
def test_linkage_of_unique_rows_and_kinds(spark, width):
    rng = np.random.default_rng(width)
    rows = sorted({(k, int(p), str(a)) for k in ("a", None) for p, a in zip(rng.integers(0, 200, 80), rng.choice(list("xy"), 80), strict=True)}, key=repr) + [("a", None, "x")]
    frame = spark.createDataFrame(rows, "k string, p long, a string")
    got = single_linkage(frame, ["k"], "p", 3, width, unique=True, kind="a").collect()
    assert len(got) == len(rows) and [r["cluster_start"] for r in got if r["p"] is None] == [None]
    for k in ("a", None):
        start, no, last, want = None, -1, None, {}
        for p, a in sorted((p, a) for kk, p, a in rows if kk == k and p is not None):
            if last is None or p - last[0] > 3 or a != last[1]:
                start, no = p, no + 1
            want[p, a], last = (start, no), (p, a)
        assert {(r["p"], r["a"]): (r["cluster_start"], r["cluster_no"]) for r in got if r["k"] == k and r["p"] is not None} == want
    once = frame.where("p is not null").dropDuplicates(["k", "p"])
    assert sorted(single_linkage(once, ["k"], "p", 3, width, unique=True).collect(), key=repr) == sorted(single_linkage(once, ["k"], "p", 3, width).collect(), key=repr)
    with pytest.raises(ValueError):
        single_linkage(frame, ["k"], "p", 3, kind="a")


@pytest.mark.parametrize("width", [1, 8, 1 << 20])
def test_linkage_in_tasks(spark, width):
    rng = np.random.default_rng(width)
    rows = sorted({(int(p), k, n) for k, n in (("a", 1), (None, 1), ("a", None), (None, None)) for p in rng.integers(-200, 200, 90)}, key=repr)
    frame = spark.createDataFrame([(f"x{i}", *r) for i, r in enumerate(rows)] + [("none", None, "a", 1)], "extra string, p int, k string, n long")
    got = single_linkage(frame, ["k", "n"], "p", 3, width, unique=True, tasks=5)
    assert got.dtypes == [*frame.dtypes, ("cluster_start", "bigint"), ("cluster_no", "bigint")]
    found = {r["extra"]: tuple(r)[1:] for r in got.collect()}
    want, last = {"none": (None, "a", 1, None, None)}, {}
    for i, (p, k, n) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        at, start, no = last.get((k, n), (None, None, -1))
        start, no = (start, no) if at is not None and p - at <= 3 else (p, no + 1)
        last[k, n], want[f"x{i}"] = (p, start, no), (p, k, n, start, no)
    assert found == want
    again = single_linkage(frame, ["k", "n"], "p", 3, width, tasks=5)
    assert {r["extra"]: tuple(r)[1:] for r in again.collect()} == want


def test_tasks_of_clusters_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SHARE", 500, raising=False)
    got = cluster_windows(spark, "/root/testdata/sf0.001")
    windows = pam_scan(spark, "/root/testdata/sf0.001").count()
    most = got.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert windows > 20 * 500 and most < 4 * 500


def test_events_of_one_instant(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cluster, "SHARE", 100, raising=False)
    minute = 60
    rows = [(None, 0), (None, None), (1, None), (1, None), (1, 0), (1, 0), (1, 10 * minute), (1, 21 * minute), *[(u, u * 11 * minute + i % 2) for u in range(2, 502) for i in range(4)]]
    spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = event_clusters(spark, str(tmp_path))
    most = got.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    m = 1_000_000
    want = {(None, 0, 0, 1), (None, None, None, 1), (1, None, None, 2), (1, 0, 600 * m, 3), (1, 1260 * m, 1260 * m, 1)} | {(u, u * 660 * m, (u * 660 + 1) * m, 4) for u in range(2, 502)}
    found = [tuple(r) for r in got.select("user_id", "cluster_start", "cluster_end", "n").collect()]
    assert len(found) == len(want) and set(found) == want and most <= 200


def test_repeated_rows_and_criteria(spark):
    twice = frame(spark, FIXTURE + FIXTURE[:2])
    primary, alternative = partition_report(twice)
    assert sorted(targets(alternative)) == ["TARGETA", "TARGETB", "TARGETB"] and primary.count() == 4
    same = [("c", 1, "+", t, 1, 0, 0, "X", 1, None, None) for t in ("B", "A", "C")]
    assert targets(partition_report(frame(spark, same))[0]) == ["A"]
    assert targets(partition_report(frame(spark, same, [0.3, None, 0.9]), criteria=["cfd"])[0]) == ["C"]
    assert targets(partition_report(frame(spark, same, [float("nan"), None, 0.1]), criteria=["cfd"])[0]) == ["C"]
    assert parse_criteria("MM, CFD") == ["mm", "cfd"]
    for bad in ("edit_distance", "aggregate", ""):
        with pytest.raises(ValueError):
            parse_criteria(bad)
    with pytest.warns(UserWarning):
        parse_criteria("crista")


def test_cfd(spark):
    rows = [("ACGTACGTACGTACGTACGT", "ACGTACGTACGTACGTACGT", "TGG"), ("ACGTACGTACGTACGTACGT", "AtGTACGTACGTACGTACGT", "AAG"), ("AC-TACGTACGTACGTACGT", "ACGTACGTACGTACGTACGa", "TGG"), ("ACGT", "ACRT", "TTT"), ("ACGT", "ACGT", "T")]
    got = [r[0] for r in spark.createDataFrame(rows, "g string, t string, p string").select(cfd(F.col("g"), F.col("t"), F.col("p"), WEIGHTS_BY_RULE)).collect()]
    want = [1.0, WEIGHTS_BY_RULE["C", "T", 1] * PAM_WEIGHTS["AG"], WEIGHTS_BY_RULE["T", "A", 19], 0.0, 0.0]
    assert got == pytest.approx(want, rel=1e-6)
    assert weights_table(spark, WEIGHTS_BY_RULE).count() == 240
    none = [r[0] for r in spark.createDataFrame(rows, "g string, t string, p string").select(cfd(F.col("g"), F.col("t"), F.col("p"), None)).collect()]
    assert none == [1.0, None, None, 0.0, 0.0]


def test_no_weights_no_score(spark):
    contigs = spark.createDataFrame([("c", "CGAGCCTCTGCCAACATACATGG"), ("d", "CGAGCCTCTGCCTACATACATGG")], "contig string, seq string")
    for weights, want in ((None, None), (WEIGHTS_BY_RULE, pytest.approx(WEIGHTS_BY_RULE["A", "T", 12]))):
        scores = {r["chromosome"]: r["CFD_score"] for r in search(contigs, "CGAGCCTCTGCCAACATACA", "NGG", Thresholds(2), weights=weights).collect()}
        assert scores == {"c": 1.0, "d": want}
    assert cli.main(["search", "--fasta", "x", "--guide", "ACGT", "--pam", "NGG", "--mm", "1", "--output", "y", "--prioritization-criteria", "cfd"], spark) == 64


def test_block_compressed_fasta(spark, tmp_path):
    import gzip

    with open(tmp_path / "a.fa.bgz", "wb") as f:  # blocks that cut lines, as bgzip does, and an empty last one
        text = b">c1 one\nACGT\nACNN\n>c2\r\nTTTT\n>c3\n"
        for k in range(0, len(text), 7):
            f.write(gzip.compress(text[k : k + 7]))
        f.write(gzip.compress(b""))
    (tmp_path / "b.fa").write_text(">d1\nGGGG\n")
    for glob, want in ((None, {"c1": "ACGTACNN", "c2": "TTTT", "c3": "", "d1": "GGGG"}), ("*.fa.bgz", {"c1": "ACGTACNN", "c2": "TTTT", "c3": ""})):
        assert {r["contig"]: r["seq"] for r in read_fasta(spark, str(tmp_path), glob).collect()} == want


def test_log_files(spark, tmp_path):
    base = ["search", "--fasta", str(tmp_path / "none"), "--guide", "ACGT", "--pam", "NGG", "--output", str(tmp_path), "--log-dir", str(tmp_path / "logs")]
    assert cli.main([*base, "--mm", "-1"], spark) == 64
    assert "caps" in (tmp_path / "logs" / "error.log").read_text() and (tmp_path / "logs" / "run.log").read_text() == ""
    assert "pam" in (tmp_path / "logs" / "verbose.log").read_text()


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from loomseq.operators.stored import shared_folder

    nowhere = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *_: None)))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(nowhere)


def test_probes_look_at_present_levels_alone(spark):
    from loomseq.operators.intervals import _filed, probe_intervals

    table = spark.createDataFrame([("c", 0, 10), ("c", 5, 70), ("c", 9, 9)], "tc string, c long, d long")
    filed, levels = _filed(table, "c", "d")
    probes = spark.createDataFrame([("c", 0, 64)], "pc string, a long, b long")
    assert sorted(r["_level"] for r in probe_intervals(probes, "a", "b", levels).collect()) == [3, 4]
    assert overlap_join(probes, table.limit(0), ("pc", "tc"), ("a", "b"), ("c", "d")).count() == 0


def test_weights_files(spark, tmp_path):
    want = {("A", "G", 0): 0.5, ("T", "A", 19): 1.0}
    serial = "(dp0\nS'rA:dC,1'\np1\nF0.5\nsS'rU:dT,20'\np2\nF1.0\ns."
    assert parse_weights(serial) == want and parse_weights("rA:dC,1\t0.5\nrU:dT,20\t1\n") == want
    with pytest.raises(ValueError):
        parse_weights("nothing")
    (tmp_path / "w.txt").write_text(serial)
    assert read_weights(spark, str(tmp_path / "w.txt")) == want


def test_overlaps_by_brute_force(spark):
    rng = np.random.default_rng(2)
    probes = [(i, f"c{i % 2}", int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(0, 5000, 60), rng.integers(0, 300, 60), strict=True))]
    feats = [(j, f"c{j % 3}", int(a), int(a + n)) for j, (a, n) in enumerate(zip(rng.integers(0, 5000, 80), [*rng.integers(0, 40, 60), *rng.integers(500, 5000, 20)], strict=True))]
    p, t = spark.createDataFrame(probes, "i int, pc string, a long, b long"), spark.createDataFrame(feats, "j int, tc string, c long, d long")
    got = [(r.i, r.j) for r in overlap_join(p, t, ("pc", "tc"), ("a", "b"), ("c", "d")).collect()]
    want = {(i, j) for i, pc, a, b in probes for j, tc, c, d in feats if pc == tc and c < b and d > a and b > a and d > c}
    assert len(got) == len(set(got)) and set(got) == want
    semi = {r.i for r in overlap_join(p, t, ("pc", "tc"), ("a", "b"), ("c", "d"), "left_semi").collect()}
    assert semi == {i for i, _ in want}
    points = [(r.i, r.j) for r in point_join(p, t, ("pc", "tc"), "a", ("c", "d")).collect()]
    assert len(points) == len(set(points)) and set(points) == {(i, j) for i, pc, a, _ in probes for j, tc, c, d in feats if pc == tc and c <= a < d}


def test_annotation_by_brute_force(spark, monkeypatch):
    """Terms of features of any length, over bins, with nulls and empty ones; no target is joined."""
    from loomseq.operators import annotate as module

    monkeypatch.setattr(module, "BIN_BITS", 6)
    rng = np.random.default_rng(3)
    rows = [(f"c{i % 3}", int(a) + 1, "A" * int(n)) for i, (a, n) in enumerate(zip(rng.integers(0, 2000, 150), rng.integers(0, 30, 150), strict=True))] + [(None, 5, "AA"), ("c0", None, "AA"), ("c0", 5, None)]
    feats = [(f"c{j % 2}", int(a), int(a + n), f"t{j % 4}", j) for j, (a, n) in enumerate(zip(rng.integers(0, 2000, 60), [*rng.integers(0, 40, 50), *rng.integers(200, 900, 10)], strict=True))] + [(None, 0, 9999, "t0", 99), ("c0", None, 9999, "t1", 99)]
    found = module.annotate(spark.createDataFrame(rows, "chromosome string, start long, target_aligned string"), spark.createDataFrame(feats, "chrom string, bed_start long, bed_end long, term string, at int"), "x", 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

    def want(c, start, text):
        if None in (c, start, text) or not text:
            return None
        return ",".join(sorted({t for k, a, z, t, _ in feats if k == c and a is not None and z > a and a < start - 1 + len(text) and z > start - 1})) or None

    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*r, want(*r)) for r in rows), key=repr)


def test_bed(spark, tmp_path):
    path = tmp_path / "a.bed"
    path.write_bytes(b"# comment\n\nchr1\t99\t110\tCTCF\r\nchr1\t105\t120\tpromoter\nchr1\t95\t101\tCTCF\nchr2\t0\t500\tlong term\n")
    bed = read_bed(spark, str(path))
    assert terms(bed) == ["CTCF", "promoter", "long term"]
    got = {r["target_aligned"]: r["x"] for r in annotate(frame(spark), bed, "x", 3).collect()}
    assert got == {"TARGETA": "CTCF,promoter", "TARGETB": "CTCF,promoter", "TARGETC": "CTCF,promoter", "TARGETD": None, "TARGETE": "long term"}
    for text in ("chr1\t1\t2\n", "chr1\t1\t2\t\n", "chr1\tx\t2\tt\n"):
        path.write_text(text)
        with pytest.raises(Exception, match="BED line"):
            read_bed(spark, str(path)).collect()
    path.write_text("".join(f"c\t{i}\t{i + 1}\tt{i}\n" for i in range(33)))
    with pytest.raises(ValueError):
        terms(read_bed(spark, str(path)))
    path.write_text("".join(f"c\t{i}\t{i + 1}\tt{i}\n" for i in range(32)))
    assert len(terms(read_bed(spark, str(path)))) == 32
    with pytest.raises(ValueError):
        annotate_all(spark, frame(spark), [str(path)] * 11, None, 3)


def test_gff(spark, tmp_path):
    (tmp_path / "a.gff").write_text("c\ts\tgene\t10\t20\t.\t+\t.\tID=1\nc\ts\texon\t12\t14\t.\t+\t.\tID=2\n")
    iv = spark.createDataFrame([("c", 9, 12), ("c", 20, 25), ("d", 0, 9)], "contig string, start long, stop long")
    got = {r["start"]: r["lines"] for r in fetch_lines(iv, read_gff(spark, str(tmp_path / "a.gff"))).collect()}
    assert got[9].count("ID=") == 2 and got[20] is None and got[0] is None


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">chr1 some > text\r\nACgt\r\nNNx\r\n>chr2\nAC\n\nGT\n>empty\n")
    (tmp_path / "b.fasta").write_text(">chr3\nACGTU")
    (tmp_path / "c.txt").write_text(">no\nAC\n")
    contigs = check_contigs(read_fasta(spark, str(tmp_path), "*.{fa,fasta}"))
    assert {r["contig"]: r["seq"] for r in contigs.collect()} == {"chr1": "ACGTNNN", "chr2": "ACGT", "chr3": "ACGTT", "empty": ""}
    assert fetch(contigs, "chr1", 1, 3).first()["seq"] == "CG" and fetch(contigs, "chr2").first()["seq"] == "ACGT"
    assert {r["contig"]: r["n_count"] for r in statistics(contigs).collect()}["chr1"] == 3
    ids = contig_ids(contigs)
    shown = contig_labels(spark.createDataFrame([(0,), (9,)], "contig_id int"), ids)
    assert {r["contig"] for r in shown.collect()} == {"chr1", "9"}
    with pytest.raises(ValueError):
        check_contigs(contigs.unionByName(contigs))
    (tmp_path / "g.fa").write_text(">1\nACGT\n>2\nacgt\n>3\nTTTT\n")
    assert read_guides(spark, str(tmp_path / "g.fa")) == ["ACGT", "TTTT"]
    for bad in ([], ["ACN"], ["A", "AC"]):
        with pytest.raises(ValueError):
            guides(bad)


SITE = "CTAACAGTTGCTTTTATCAC"


@pytest.fixture
def genome(tmp_path):
    left = "ACGTACGATT" * 5
    seq = left + "A" + SITE + "TGG" + left + reverse_complement_text("A" + SITE[:5] + "G" + SITE[6:] + "AGG") + left
    (tmp_path / "genome").mkdir()
    (tmp_path / "genome" / "x.fa").write_text(f">chrA\n{seq[:60]}\n{seq[60:]}\n")
    return tmp_path, seq


def test_search(spark, genome):
    folder, seq = genome
    found = search(read_fasta(spark, str(folder / "genome")), SITE, "NGG", Thresholds(2))
    rows = {r["strand"]: r for r in found.collect()}
    plus, minus = rows["+"], rows["-"]
    assert (plus["start"], plus["sgRNA_aligned"], plus["target_aligned"], plus["mismatches"], plus["CFD_score"]) == (seq.index(SITE) + 1, SITE + "NGG", SITE + "TGG", 0, 1.0)
    at = minus["start"] - 1
    assert reverse_complement_text(seq[at : at + 23]) == minus["target_aligned"].upper() and minus["target_aligned"][5] == "g" and minus["mismatches"] == 1
    assert found.columns == REPORT
    no_score = search(read_fasta(spark, str(folder / "genome")), SITE, "NGGNNN"[:4], Thresholds(1))
    assert all(r["CFD_score"] is None for r in no_score.collect())


def test_files_and_cli(spark, genome):
    folder, seq = genome
    bed = folder / "f.bed"
    bed.write_text(f"chrA\t{seq.index(SITE)}\t{seq.index(SITE) + 1}\there\n")
    args = ["search", "--fasta", str(folder / "genome"), "--guide", SITE, "--pam", "NGG", "--mm", "2", "--bdna", "1", "--brna", "1", "--annotation", str(bed), "--annotation-colnames", "site", "--output", str(folder / "out")]
    assert cli.main(args, spark) == 0
    primary = read_report(spark, str(folder / "out" / f"{SITE}_NGG_primary.tsv"))
    alternative = read_report(spark, str(folder / "out" / f"{SITE}_NGG_alternative.tsv"))
    best = [r for r in primary.collect() if r["mismatches"] == 0 and r["edit_distance"] == 0]
    assert len(best) == 1 and best[0]["site"] == "here" and best[0]["CFD_score"] == 1.0 and alternative.count() > 0
    again = partition_report(primary.unionByName(alternative))
    assert again[0].count() == primary.count()
    text = rendered(primary).where("site = 'here'").first()
    assert text["CFD_score"] == "1.00" and text["CRISTA_score"] == "NA"
    write_report(primary.limit(0), str(folder / "none"))
    assert read_report(spark, str(folder / "none")).count() == 0
    assert cli.main([*args[:6], "NXG", *args[7:]], spark) == 64
    assert cli.main([*args, "--max-edit-distance", "9"], spark) == 64
    with pytest.raises(ValueError):
        search_reference(spark, str(folder / "genome"), SITE, "NGG", Thresholds(1), annotations=[str(bed)], annotation_names=["a", "b"])


def test_short_row_fails(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("\t".join(REPORT) + "\tgene\tregulatory\n" + "chr1\t1\t+\tG\n")
    with pytest.raises(Exception):  # noqa: B017
        read_report(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "odd.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        read_report(spark, str(tmp_path / "odd.tsv"))


def test_upstream(spark):
    site = "GATTACAGATTACAGATTAC"
    seq = "CCCCC" + "TTTA" + site + "CCCCCCCC" + reverse_complement_text("TTTC" + site) + "CC"
    contigs = spark.createDataFrame([("c", seq)], "contig string, seq string")
    rows = {r["strand"]: r for r in search(contigs, site, "TTTV", Thresholds(0), upstream=True).collect()}
    assert (rows["+"]["start"], rows["+"]["target_aligned"], rows["+"]["sgRNA_aligned"]) == (6, "TTTA" + site, "TTTV" + site)
    at = rows["-"]["start"] - 1
    assert reverse_complement_text(seq[at : at + 24]) == rows["-"]["target_aligned"]




@pytest.mark.parametrize("seed", [0, 1])
def test_partition_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"chr{rng.integers(0, 3)}", int(rng.integers(1, 120)), "+-"[rng.integers(0, 2)], "TG"[rng.integers(0, 2)], int(rng.integers(0, 3)), int(rng.integers(0, 2)), 0, "X", 3, None, None) for _ in range(150)]
    scores = [[None, 0.5, float("nan"), 0.25][rng.integers(0, 4)] for _ in rows]
    primary, alternative = partition_report(frame(spark, rows, scores), 2, ["cfd", "mm"])

    def key(r):
        bad = r["CFD_score"] is None or np.isnan(r["CFD_score"])
        return bad, 0 if bad else -r["CFD_score"], r["mismatches"], r["strand"] == "+", r["target_aligned"], r["start"]

    groups = {}
    for r in frame(spark, rows, scores).collect():
        groups.setdefault((r["chromosome"], r["strand"]), []).append(r)
    best = []
    for own in groups.values():
        own.sort(key=lambda r: r["start"])
        cluster = []
        for r in own:
            if cluster and r["start"] - cluster[-1]["start"] > 2:
                best.append(min(map(key, cluster)))
                cluster = []
            cluster.append(r)
        best.append(min(map(key, cluster)))
    got = primary.collect()
    assert sorted(map(key, got)) == sorted(best)
    assert len(got) + alternative.count() == len(rows)
