from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomseq.functions.alphabet import MASK, reverse_complement_text
from loomseq.operators.align import Thresholds, align, align_matrix, hamming
from loomseq.operators.scan import expand, protospacer, scan_windows, search_hits, window_statistics
from loomseq.search import search

GUIDE = "CTAACAGTTGCTTTTATCAC"


def brute(guide: str, window: str, caps: Thresholds) -> set[tuple[int, str]]:
    """Every (offset, script) by plain recursion; ``window`` is without the PAM."""
    stop, pad = len(window), len(window) - len(guide)
    out = set()

    def go(i, j, mm, dna, rna, ops, offset):
        if mm > caps.mm or dna > caps.bdna or rna > caps.brna or mm + dna + rna > caps.total:
            return
        if i == len(guide) and j == stop:
            out.add((offset, ops))
        if i < len(guide) and j < stop:
            same = MASK[guide[i]] & MASK[window[j]]
            go(i + 1, j + 1, mm + (not same), dna, rna, ops + ("=" if same else "X"), offset)
        if i and j < stop:
            go(i, j + 1, mm, dna + 1, rna, ops + "I", offset)
        if i < len(guide):
            go(i + 1, j, mm, dna, rna + 1, ops + "D", offset)

    for offset in range(max(0, pad - caps.bdna), pad + caps.brna + 1):
        go(0, offset, 0, 0, 0, "", offset)
    return out


def ours(guide, window, caps, upstream=False):
    got = align_matrix(np.frombuffer(window.encode(), np.uint8)[None, :], guide, caps, upstream)
    if not got:
        return set(), []
    _, cols = got
    rows = list(zip(*(c.to_pylist() for c in cols), strict=True))
    return {(r[0], r[1]) for r in rows}, rows


@pytest.mark.parametrize(
    "guide, window, caps, n, some",
    [
        (GUIDE, "ACTAACAGTTGCTTTTATCAC", (0, 0, 0), 1, [(1, "=" * 20)]),
        (GUIDE, "ACTAACAGTTGCTTTTATCAC", (0, 1, 1), 57, [(2, "D" + "=" * 19)]),
        (GUIDE, "ACTAACAGTTGCTTTTATCAC", (4, 1, 1), 246, []),
        (GUIDE, "CTAACAGATGCTTTTATCAC", (2, 0, 0), 1, [(0, "=======X============")]),
        ("ACGT", "AACGT", (1, 1, 1), 17, [(0, "=I==="), (0, "=XI=="), (1, "===="), (2, "D==="), (2, "XD==")]),
        ("ACGT", "ACGT", (1, 1, 1), 15, []),
    ],
)
def test_known_counts(guide, window, caps, n, some):
    got, rows = ours(guide, window, Thresholds(*caps))
    assert len(got) == len(rows) == n and set(some) <= got


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=4, max_size=7), st.text("ACGTRN", min_size=3, max_size=9), st.tuples(*[st.integers(0, 2)] * 3), st.integers(0, 4))
def test_against_recursion(guide, window, caps, most):
    t = Thresholds(*caps, most)
    got, rows = ours(guide, window, t)
    assert got == brute(guide, window, t) and len(rows) == len(got)
    for offset, ops, rguide, rseq, mm, bdna, brna in rows:
        assert (ops.count("X"), ops.count("I"), ops.count("D")) == (mm, bdna, brna)
        assert rguide.replace("-", "") == guide and rseq.replace("-", "").upper() == window[offset:]
        assert all(c.islower() == (o == "X") or c == "-" for c, o in zip(rseq, ops, strict=True))
    mirrored, _ = ours(guide[::-1], window[::-1], t, upstream=True)
    assert mirrored == {(o, s[::-1]) for o, s in got}


def test_thresholds():
    assert Thresholds(4, 1, 2).total == 7 and Thresholds(4, 1, 1, 3).total == 3 and Thresholds(1, 1, 1, 9).total == 3
    with pytest.raises(ValueError):
        Thresholds(-1)


def scan_by_hand(seqs, pam, size, upstream):
    out = set()
    for name, seq in seqs.items():
        for strand in "+-":
            s = seq if strand == "+" else reverse_complement_text(seq)
            for i in range(len(s) - size + 1):
                w = s[i : i + size]
                p = w[: len(pam)] if upstream else w[size - len(pam) :]
                if "N" not in w and all(MASK[a] & MASK[b] for a, b in zip(p, pam, strict=True)):
                    out.add((name, strand, i if strand == "+" else len(s) - i - size, w, p))
    return out


@pytest.mark.parametrize("pam, upstream", [("NGG", False), ("TTTV", True), ("NNN", False), ("NGK", False)])
@pytest.mark.parametrize("chunk", [7, 50, 100_000])
def test_scan(spark, pam, upstream, chunk):
    rng = np.random.default_rng(3)
    seqs = {f"c{k}": "".join(rng.choice(list("ACGTNR"), n, p=[0.23, 0.23, 0.24, 0.27, 0.02, 0.01])) for k, n in enumerate((0, 5, 12, 13, 200, 311))}
    contigs = spark.createDataFrame(list(seqs.items()), "contig string, seq string")
    got = [tuple(r) for r in scan_windows(contigs, pam, 12, upstream, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == scan_by_hand(seqs, pam, 12, upstream)


@pytest.mark.parametrize("upstream", [False, True])
def test_search_is_scan_align_expand(spark, upstream):
    rng = np.random.default_rng(5)
    site = "ACGTACCA"
    seq = "".join(rng.choice(list("ACGT"), 600)) + "A" + site + "TGG" + "".join(rng.choice(list("ACGT"), 50)) + "TGG" + site + "A" + "AAACCA" + reverse_complement_text("T" + site + "CGG") * 3
    contigs = spark.createDataFrame([("a", seq), ("b", seq[::-1]), ("c", "")], "contig string, seq string")
    caps, pam = Thresholds(2, 1, 1), "NGG"
    guides = [site, "TTGGCCAA"]
    hits = search_hits(contigs, guides, pam, caps, upstream, chunk=64).select("contig", "strand", "pos", "guide", "offset", "ops", "rguide", "rseq", "mm", "bdna", "brna")
    windows = protospacer(scan_windows(contigs, pam, 12, upstream), 3, upstream)
    two_step = expand(windows, align(windows.select("protospacer").distinct(), guides, caps, upstream=upstream)).select(*hits.columns)
    rows = sorted(map(tuple, hits.collect()))
    assert rows and rows == sorted(map(tuple, two_step.collect()))
    stats = window_statistics(windows).first()
    assert stats["hits"] == windows.count() and stats["unique_windows"] == windows.select("protospacer").distinct().count()


def test_align_odd_input(spark):
    rows = spark.createDataFrame([(None,), ("",), ("AC",), ("ACGT",), ("TACGT",)], "protospacer string")
    got = align(rows, ["ACGT"], Thresholds(0, 1, 1)).select("protospacer", "offset", "ops").collect()
    assert {r["protospacer"] for r in got} == {"ACGT", "TACGT"}
    assert align(rows.limit(0), ["ACGT"], Thresholds(0)).count() == 0
    assert [r["mm"] for r in hamming(spark.createDataFrame([("TACGA",)], "protospacer string"), "ACGT").collect()] == [1]


def test_all_combinations_of_scripts_are_distinct():
    windows = ["".join(p) for p in product("AC", repeat=6)]
    m = np.frombuffer("".join(windows).encode(), np.uint8).reshape(-1, 6)
    rows, cols = align_matrix(m, "ACACA", Thresholds(2, 1, 1))
    found = {}
    for r, o, s in zip(rows, cols[0].to_pylist(), cols[1].to_pylist(), strict=True):
        found.setdefault(windows[r], set()).add((o, s))
    assert sum(map(len, found.values())) == len(rows)
    for w in windows:
        assert found.get(w, set()) == brute("ACACA", w, Thresholds(2, 1, 1))


def test_free_end_distance(spark):
    from functools import lru_cache

    from loomseq.operators.align import INVALID, free_end_distance

    guide, rng = "ACGTRN", np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in rng.integers(1, 12, 80)] + ["", None, "ACNGT", "ACGTAC", "TTACGTATT", "acgtgg"]

    def least(text):
        if "N" in text:
            return INVALID

        @lru_cache(None)
        def d(q, t):
            if q == 0:
                return 0
            cost = [d(q - 1, t) + 1]
            if t:
                same = text[t - 1].upper() in {"R": "AG", "N": "ACGT"}.get(guide[q - 1], guide[q - 1])
                cost += [d(q, t - 1) + 1, d(q - 1, t - 1) + (not same)]
            return min(cost)

        return min(d(len(guide), t) for t in range(len(text) + 1))

    got = free_end_distance(spark.createDataFrame([(t, 1) for t in texts], "protospacer string, distance int"), guide).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((t, None if t is None else least(t)) for t in texts), key=repr)


def test_counters(spark):
    from loomseq.operators.metrics import Counters

    counters = Counters()
    contigs = spark.createDataFrame([("c", "ACGTACGTACGTTGG" * 3)], "contig string, seq string")
    rows = search(contigs, "ACGTACGTACGT", "NGG", Thresholds(1), transforms=[counters.stage("found"), lambda r: r.where("mismatches = 0"), counters.stage("exact", last=F.max("start"))]).collect()
    totals = counters.totals()
    assert totals["exact"] == {"items": len(rows), "last": max(r["start"] for r in rows)} and totals["found"]["items"] >= len(rows) > 0
    with pytest.raises(ValueError):
        counters.stage("found")
