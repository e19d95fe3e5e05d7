import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq import cli
from loomseq.functions.alphabet import reverse_complement_text
from loomseq.operators.align import Thresholds
from loomseq.operators.liftover import lift_points, lift_report, lift_statistics
from loomseq.operators.merge import merge_assemblies, merge_global, merge_sample, presence_rows, render_presence, render_samples, sample_table, union_presence
from loomseq.operators.report import read_report
from loomseq.schemas import CHAIN_BLOCKS, report_schema
from loomseq.search import search_assemblies
from loomseq.sources.assembly import discover, match_manifest
from loomseq.sources.binary import encode_positions, encode_windows, read_dataset, read_windows, write_windows
from loomseq.sources.chain import blocks_from_steps, parse_chain, ranked_chains, read_chain
from loomseq.sources.fasta import check_haplotypes, read_fasta

CHAIN = "chain 100 T 20 + 0 11 Q 30 {} 0 12 1\n5 2 3\n4\n"


@pytest.mark.parametrize("strand, blocks", [("+", [(0, 5, 0, 5), (7, 11, 8, 12)]), ("-", [(0, 5, 25, 30), (7, 11, 18, 22)])])
def test_parse_chain(strand, blocks):
    got = [(r[3], r[4], r[6], r[7]) for r in parse_chain("# comment\n\n" + CHAIN.format(strand))]
    assert got == blocks


@pytest.mark.parametrize("text", ["5 2 3\n", CHAIN.format("+").replace("0 11", "0 12"), "chain 1 T 20 + 0 11 Q 30 + 0 12 1\n5 2\n", "chain 1 T 20 + 0 11 Q\n", CHAIN.format("+") + "4\n", "chain x T 20 + 0 11 Q 30 + 0 12 1\n", "chain 1 T 20 + 0 11 Q 30 + 0 12 1\n5 2 3\n"])
def test_bad_chains(text):
    with pytest.raises(ValueError, match="line"):
        list(parse_chain(text))


def test_chain_order(spark, tmp_path):
    two = CHAIN.format("+").replace("chain 100", "chain 10") + "\n" + CHAIN.format("-").replace("chain 100", "chain 999")
    with gzip.open(tmp_path / "a.chain.gz", "wt") as f:
        f.write(two)
    got = ranked_chains(read_chain(spark, str(tmp_path / "a.chain.gz"))).orderBy("rank").collect()
    assert [r["score"] for r in got] == [999, 10]


def test_chain_by_lines(spark, tmp_path):
    """Lines are read one by one, and files are told apart whatever batches their lines come in."""
    endless = iter(["chain 1 T 99 + 0 99 Q 99 + 0 99 1", "1 1 1", "1 1 1"])
    assert next(parse_chain(endless))[3:5] == (0, 1) and next(endless) == "1 1 1"
    texts = [CHAIN.format("+") * 3, "", CHAIN.format("-").replace("\n", "\r\n") + "\n# end"]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.chain").write_text(text, newline="")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = read_chain(spark, str(tmp_path)).drop("file").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got)) == sorted(r for text in texts for r in parse_chain(text))


def test_blocks_from_steps(spark):
    for strand in "+-":
        chains = spark.createDataFrame([(1, 100, "T", 0, "Q", 30, 0, strand, 0)], "chain_id long, score long, t_name string, t_start long, q_name string, q_size long, q_start long, q_strand string, file_order long")
        steps = spark.createDataFrame([(1, 0, 5, 2, 3), (1, 1, 4, 0, 0)], "chain_id long, step_no long, size long, dt long, dq long")
        want = [(r[3], r[4], r[6], r[7]) for r in parse_chain(CHAIN.format(strand))]
        assert sorted((r["t_start"], r["t_end"], r["q_start"], r["q_end"]) for r in blocks_from_steps(chains, steps).collect()) == want


def lift_by_hand(blocks, contig, pos, tolerance):
    hits = []
    for b in blocks:
        if b[2] == contig and b[3] <= pos < b[4]:
            hits.append((-b[1], b[9], b[5], b[6] + pos - b[3] if b[8] == "+" else b[7] - 1 - (pos - b[3]), b[8] == "-"))
    if not hits:
        return None, None, None, "unmapped"
    _, _, name, q, flip = min(hits)
    return name, q, flip, "ambiguous" if any(abs(h[3] - q) > tolerance for h in hits) else "mapped"


def test_lift_by_hand(spark):
    rng = np.random.default_rng(6)
    blocks = []
    for k in range(40):
        n, t = int(rng.integers(1, 900)), int(rng.integers(0, 3000))
        q = t + int(rng.choice([0, 5, 50]))
        blocks.append((k, int(rng.integers(1, 6)), f"c{k % 3}", t, t + n, f"r{k % 2}", q, q + n, "+-"[k % 5 == 0], k))
    points = [(i, f"c{i % 4}", int(p)) for i, p in enumerate(rng.integers(0, 4000, 300))] + [(900, None, 5), (901, "c0", None)]
    got = lift_points(spark.createDataFrame(points, "i int, contig string, pos long"), spark.createDataFrame(blocks, CHAIN_BLOCKS), 10).collect()
    assert len(got) == len(points)
    for r in got:
        want = (None, None, None, "unmapped") if r["contig"] is None or r["pos"] is None else lift_by_hand(blocks, r["contig"], r["pos"], 10)
        assert (r["ref_contig"], r["ref_pos"], r["flipped"], r["map_status"]) == want
    assert {r["map_status"] for r in got} == {"mapped", "ambiguous", "unmapped"}


def joined_rows(df):
    """Rows that the joins of a plan put out when it runs."""
    df._jdf.queryExecution().toRdd().count()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below = node.children()
        rows = node.metrics().get("numOutputRows") if "Join" in kind else None
        return sum(walk(below.apply(i)) for i in range(below.size())) + (rows.get().value() if rows is not None and rows.isDefined() else 0)

    return walk(df._jdf.queryExecution().executedPlan())


def test_lift_makes_no_pairs(spark):
    """400 blocks over 200 points: 80000 pairs, of which none but the winners' may be joined."""
    blocks = [(k, k % 90, "c", 0, 200 + k % 3, f"r{k % 2}", 5 * k, 5 * k + 200 + k % 3, "+-"[k % 2], k) for k in range(400)] + [(900, None, "c", 0, 300, "r9", 0, 300, "+", 900)]
    points = [("c", p) for p in range(200)]
    lifted = lift_points(spark.createDataFrame(points, "contig string, pos long"), spark.createDataFrame(blocks, CHAIN_BLOCKS))
    assert joined_rows(lifted) < 5000
    for r in lifted.collect():
        want = lift_by_hand(blocks[:400], "c", r["pos"], 10)
        assert (r["ref_contig"], r["ref_pos"], r["flipped"], r["map_status"]) == want


def rep(spark, rows, extra="", tail=()):
    full = [(c, s, st, "GUIDE", t, mm, 0, 0, "X", mm, None, None, None, None, *tail_) for (c, s, st, t, mm), tail_ in rows]
    return spark.createDataFrame(full, report_schema() + extra)


def test_lift_report(spark):
    blocks = spark.createDataFrame([(1, 1, "CM1", 0, 5, "chr2", 100, 105, "+", 0), (2, 1, "CM2", 10, 60, "chr3", 200, 250, "-", 1)], CHAIN_BLOCKS)
    rows = rep(spark, [(("S#1#CM1", 2, "+", "A", 0), ()), (("S#1#CM1", 9, "+", "A", 0), ()), (("S#1#CM2", 21, "+", "AC-GT", 0), ())])
    got = {(r["chromosome"], r["start"]): (r["hg38_chr"], r["hg38_pos"], r["hg38_flipped"], r["map_status"]) for r in lift_report(rows, blocks).collect()}
    assert got["S#1#CM1", 2] == ("chr2", 102, 0, "mapped") and got["S#1#CM1", 9] == (None, None, None, "unmapped")
    # bases 20..23 of the contig; the last one, 23, lands leftmost at 249 - 13
    assert got["S#1#CM2", 21] == ("chr3", 237, 1, "mapped")
    assert tuple(lift_statistics(lift_report(rows, blocks)).first()) == (2, 0, 1)


LIFTED = ", annotation long, sample string, hap int, hg38_chr string, hg38_pos long, hg38_flipped int, map_status string"


def lifted(spark, rows):
    """rows: sample, hap, native start, allele, mm, reference place or None."""
    return rep(spark, [((f"{s}#{h}#c", n, "+", t, mm), (1 << k % 2, s, h, *(("chr1", p, 0, "mapped") if p is not None else (None, None, None, "unmapped")))) for k, (s, h, n, t, mm, p) in enumerate(rows)], LIFTED)


LAYOUT = {"HG1": [1, 2], "HG2": [2, 1]}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("HG1", 1, 5, "A", 1, 100), ("HG1", 2, 9, "A", 1, 101)], [("HG1:1|1", "mapped", 100)]),
        ([("HG1", 1, 5, "A", 1, 100)], [("HG1:1|0", "mapped", 100)]),
        ([("HG1", 1, 5, "A", 1, 100), ("HG1", 2, 5, "C", 1, 100)], [("HG1:0|1", "mapped", 100), ("HG1:1|0", "mapped", 100)]),
        ([("HG1", 1, 5, "A", 1, 100), ("HG1", 1, 5, "A", 1, None)], [("HG1:1|0", "mapped", 100), ("HG1:1|0", "unmapped", 5)]),
        ([("HG1", 1, 5, "A", 1, 100), ("HG2", 1, 6, "A", 1, 102), ("HG2", 2, 6, "A", 0, 102)], [("HG1:1|0,HG2:1|1", "mapped", 102)]),
        ([("HG1", 1, 5, "A", 1, 100), ("HG1", 1, 5, "C", 1, 101), ("HG1", 2, 5, "A", 1, 102)], [("HG1:1|0", "mapped", 101), ("HG1:1|1", "mapped", 100)]),
    ],
)
def test_merge(spark, rows, want):
    got = merge_assemblies(lifted(spark, rows), sample_table(spark, LAYOUT), 3).collect()
    assert sorted((r["samples"], r["map_status"], r["start"]) for r in got) == sorted(want)


def test_merge_adjacent_only_and_annotation(spark):
    rows = lifted(spark, [("HG1", 1, 5, "A", 1, 100), ("HG1", 1, 5, "C", 1, 101), ("HG1", 2, 5, "A", 1, 102)])
    samples = sample_table(spark, LAYOUT)
    assert merge_assemblies(rows, samples, 3, adjacent_only=True).count() == 3
    per = merge_sample(presence_rows(rows, samples), 3)
    assert sorted((r["target_aligned"], r["mask"], r["annotation"]) for r in per.collect()) == [("A", 3, 1), ("C", 1, 2)]
    assert merge_global(per, 3).count() == 2
    with pytest.raises(Exception, match="not in the sample table"):
        merge_assemblies(lifted(spark, [("HG9", 1, 5, "A", 1, 100)]), samples).collect()
    with pytest.raises(ValueError):
        sample_table(spark, {"a": [1, 1]})


@pytest.mark.parametrize("adjacent_only", [False, True])
def test_merge_by_hand(spark, adjacent_only):
    """Clusters within samples, then over all, by plain loops."""
    rng = np.random.default_rng(9)
    given = [(f"HG{rng.integers(1, 3)}", int(rng.integers(1, 3)), 5, str(rng.choice(["A", "C"])), int(rng.integers(0, 3)), int(rng.integers(100, 160))) for _ in range(90)]

    def runs(places):
        """(allele, start) -> start of its cluster."""
        out, last, open_at = {}, {}, {}
        before = None
        for start, allele in sorted(places):
            broken = before is not None and before != allele and adjacent_only
            if broken or allele not in last or start - last[allele] > 3 or (adjacent_only and start - prev > 3):
                open_at[allele] = start
            out[allele, start], last[allele], before, prev = open_at[allele], start, allele, start
        return out

    per = {}
    for sample in ("HG1", "HG2"):
        own = [r for r in given if r[0] == sample]
        at = runs({(r[5], r[3]) for r in own})
        for r in own:
            best = per.setdefault((sample, r[3], at[r[3], r[5]]), [None, 0])
            best[0] = min(best[0] or (r[4], r[5]), (r[4], r[5]))
            best[1] |= 1 << sorted(LAYOUT[sample]).index(r[1])
    at = runs({(best[0][1], allele) for (_, allele, _), best in per.items()})
    whole = {}
    for (sample, allele, _), (best, mask) in per.items():
        x = whole.setdefault((allele, at[allele, best[1]]), [None, {}])
        x[0] = min(x[0] or best, best)
        x[1][sample] = x[1].get(sample, 0) | mask
    want = sorted((a, x[0][1], x[0][0], ",".join(f"{s}:{m & 1}|{m >> 1 & 1}" for s, m in sorted(x[1].items()))) for (a, _), x in whole.items())
    got = merge_assemblies(lifted(spark, given), sample_table(spark, LAYOUT), 3, adjacent_only=adjacent_only).collect()
    assert sorted((r["target_aligned"], r["start"], r["mismatches"], r["samples"]) for r in got) == want


def test_presence(spark):
    row = spark.range(1).select(render_presence(F.lit(10).cast("long"), F.lit(4)).alias("x")).first()
    assert row["x"] == "0|1|0|1"
    kind = "array<struct<sample_id:int,sample:string,mask:bigint,ploidy:int>>"
    df = spark.createDataFrame([([(0, "a", 1, 2)], [(0, "a", 2, 2), (1, "b", 1, 2)])], f"x {kind}, y {kind}")
    assert df.select(render_samples(union_presence(F.col("x"), F.col("y")))).first()[0] == "a:1|1,b:1|0"


def test_manifest(spark):
    f = spark.createDataFrame([("a", 1, "f1"), ("a", 2, "f2"), ("a", 2, "f3")], "sample string, hap int, fasta string")
    c = spark.createDataFrame([("a", 1, "c1"), ("a", 2, "c2"), ("b", 1, "c3")], "sample string, hap int, chain string")
    assert {(r["sample"], r["hap"]): r["problem"] for r in match_manifest(f, c).collect()} == {("a", 1): None, ("a", 2): "several FASTA files", ("b", 1): "no FASTA"}


SITE = "CTAACAGTTGCTTTTATCAC"


@pytest.fixture
def assemblies(tmp_path):
    left = "ACGTACGATT" * 4
    seq = left + "A" + SITE + "TGG" + left
    (tmp_path / "asm").mkdir()
    (tmp_path / "chains").mkdir()
    for s in ("HG1", "HG2"):
        for h in (1, 2):
            own = seq if (s, h) != ("HG1", 2) else reverse_complement_text(seq)
            if (s, h) == ("HG2", 2):
                own = own.replace(SITE, SITE[::-1])
            (tmp_path / "asm" / f"{s}.{h}.fa").write_text(f">{s}#{h}#ctg\n{own}\n")
            n, strand = len(seq), "+-"[(s, h) == ("HG1", 2)]
            (tmp_path / "chains" / f"{s}_hap{h}_hg38.chain").write_text(f"chain 100 ctg {n} + 0 {n} chr1 {n + 50} {strand} {0 if strand == '-' else 50} {n if strand == '-' else n + 50} 1\n{n}\n")
    return tmp_path, seq


def test_assemblies(spark, assemblies):
    folder, seq = assemblies
    inputs = discover(spark, str(folder / "asm"), str(folder / "chains"))
    assert inputs.layout == {"HG1": [1, 2], "HG2": [1, 2]}
    primary, alternative = search_assemblies(spark, str(folder / "asm"), str(folder / "chains"), SITE, "NGG", Thresholds(1))
    got = [(r["chromosome"], r["start"], r["strand"], r["samples"], r["map_status"]) for r in primary.collect()]
    assert got == [("chr1", 50 + seq.index(SITE) + 1, "+", "HG1:1|1,HG2:1|0", "mapped")] and alternative.count() == 0
    args = ["search-assembly", "--assemblies", str(folder / "asm"), "--chains", str(folder / "chains"), "--guide", SITE, "--pam", "NGG", "--mm", "1", "--output", str(folder / "out"), "--output-prefix", "all"]
    assert cli.main(args, spark) == 0
    assert read_report(spark, str(folder / "out" / "all_primary.tsv")).first()["samples"] == "HG1:1|1,HG2:1|0"
    (folder / "chains" / "HG2_hap2_hg38.chain").unlink()
    assert cli.main(args, spark) == 65
    (folder / "asm" / "HG2.2.fa").unlink()
    with pytest.raises(ValueError, match="differ"):
        discover(spark, str(folder / "asm"), str(folder / "chains"))


def test_mixed_haplotypes(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">HG1#1#a\nAC\n>HG1#2#a\nAC\n")
    with pytest.raises(ValueError):
        check_haplotypes(read_fasta(spark, str(tmp_path)))


def test_binary(spark, tmp_path):
    windows, positions = ["ACGT", "NRYA", "TTTT"], [[10, 20], [30], [40, 50, 60]]
    (tmp_path / "w").write_bytes(encode_windows(windows))
    (tmp_path / "p").write_bytes(encode_positions(positions))
    got = sorted((r["idx"], r["window"], r["position"]) for r in read_dataset(spark, str(tmp_path / "w"), str(tmp_path / "p"), 4).collect())
    assert got == [(i, windows[i], p) for i, ps in enumerate(positions) for p in ps]
    write_windows(read_windows(spark, str(tmp_path / "w"), 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="no rows of 5"):
        read_windows(spark, str(tmp_path / "w"), 5).collect()


def test_files_to_files(spark, assemblies):
    from loomseq.operators.report import write_report
    from loomseq.search import lift_file, merge_files, partition_file, search

    folder, _ = assemblies
    lifted = []
    for s, h in (("HG1", 1), ("HG1", 2), ("HG2", 1)):
        found = search(read_fasta(spark, str(folder / "asm" / f"{s}.{h}.fa")), SITE, "NGG", Thresholds(1))
        write_report(found, str(folder / f"{s}{h}.tsv"))
        counts = lift_file(spark, str(folder / f"{s}{h}.tsv"), str(folder / "chains" / f"{s}_hap{h}_hg38.chain"), str(folder / f"{s}{h}.lifted.tsv"))
        assert counts == {"mapped": 1, "ambiguous": 0, "unmapped": 0}
        lifted.append((s, h, str(folder / f"{s}{h}.lifted.tsv")))
    merge_files(spark, lifted, str(folder / "merged.tsv"))
    assert partition_file(spark, str(folder / "merged.tsv"), str(folder / "p.tsv"), str(folder / "a.tsv")) == {"clusters": 1, "primary": 1, "alternative": 0}
    assert read_report(spark, str(folder / "p.tsv")).first()["samples"] == "HG1:1|1,HG2:1"
    with pytest.raises(ValueError, match="no columns"):
        merge_files(spark, [("HG1", 1, str(folder / "HG11.tsv"))], str(folder / "x.tsv"))
