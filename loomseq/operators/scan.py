"""Windows next to a PAM on both strands, and the search that aligns them where they are found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.functions.alphabet import MASK, check, reverse_complement_text
from loomseq.operators.align import MASKS, Thresholds, align_matrix, strings
from loomseq.schemas import WINDOWS
from loomseq.sources.fasta import CHUNK, chunks, spread

_UPPER = np.frombuffer(bytes(ord(chr(i).upper().replace("U", "T")) if i < 128 and chr(i).upper() in MASK else ord("N") for i in range(256)), np.uint8)
_COMPLEMENT = np.array([ord(reverse_complement_text(chr(c))) for c in _UPPER], np.uint8)
HITS = "contig string, strand string, pos long, window string, guide string, offset int, ops string, rguide string, rseq string, mm int, bdna int, brna int"
STRANDS = ("+", "-")
#: Windows that a task holds at a time.
GROUP = 200_000


def hits_of(text: np.ndarray, pam: str, size: int, upstream: bool, core: int) -> dict[str, np.ndarray]:
    """Starts below ``core`` of the windows of each strand: without N, and with the PAM at their right end in their own direction (left end if ``upstream``)."""
    n = len(text) - size + 1
    if n <= 0:
        return {s: np.zeros(0, np.int64) for s in STRANDS}
    masks = MASKS[text]
    blank = np.concatenate([[0], np.cumsum((masks == 15) | (masks == 0))])
    out = {}
    for strand, motif, left in (("+", pam, upstream), ("-", reverse_complement_text(pam), not upstream)):
        at = 0 if left else size - len(pam)
        good = np.ones(n, bool)
        for i, c in enumerate(motif):
            if MASK[c] != 15:  # N fits anything
                good &= (masks[at + i : at + i + n] & MASK[c]) != 0
        starts = np.flatnonzero(good[:core])
        out[strand] = starts[blank[starts + size] == blank[starts]]
    return out


def text_of(text: np.ndarray, starts: np.ndarray, size: int, strand: str) -> np.ndarray:
    """A matrix of the windows' bases in their own direction."""
    m = np.lib.stride_tricks.sliding_window_view(text, size)[starts]
    return m if strand == "+" else _COMPLEMENT[m[:, ::-1]]


def _found(batches, pam: str, size: int, upstream: bool):
    """(batch, row, strand, pos, bases) of the windows in chunks, some GROUP at a time."""
    for b in batches:
        found, held = [], 0
        for k in range(b.num_rows):
            text = _UPPER[np.frombuffer(b.column("seq")[k].as_buffer(), np.uint8)]
            start = b.column("start")[k].as_py()
            for s, (strand, starts) in enumerate(hits_of(text, pam, size, upstream, b.column("core")[k].as_py()).items()):
                if len(starts):
                    found.append((np.full(len(starts), k), np.full(len(starts), s), starts + start, text_of(text, starts, size, strand)))
                    held += len(starts)
            if held >= GROUP:
                yield b, *(np.concatenate(x) for x in zip(*found, strict=True))
                found, held = [], 0
        if found:
            yield b, *(np.concatenate(x) for x in zip(*found, strict=True))


_MIX = np.random.default_rng(1).integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct one, each row's distinct one). Rows are told apart by a 64-bit sum; should two different ones ever share it, all count as distinct."""
    with np.errstate(over="ignore"):
        key = (rows.astype(np.uint64) * _MIX[: rows.shape[1]]).sum(1)
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    if (rows[first[of]] != rows).any():
        first = of = np.arange(len(rows))
    return first, of


def window_size(guide_length: int, pam: str, caps: Thresholds) -> int:
    return guide_length + len(pam) + caps.pad


def _cut(contigs: DataFrame, size: int, chunk: int) -> DataFrame:
    return spread(chunks(contigs, size - 1, chunk), "contig", "start")


def scan_windows(contigs: DataFrame, pam: str, size: int, upstream: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``contig, strand, pos, window, pam``: every window of ``size`` bases next to the PAM, once each.

    ``pos`` is the window's first base on the forward strand, from 0; ``window`` reads in its own direction. Windows
    with an N, or that reach over a contig's end, don't count. A window belongs to the chunk in which it begins, so
    nothing is found twice and nothing needs a shuffle.
    """
    pam = check(pam)
    if size < len(pam):
        raise ValueError("windows are shorter than the PAM")

    def run(batches):
        import pyarrow as pa

        for b, row, strand, pos, windows in _found(batches, pam, size, upstream):
            own = windows[:, : len(pam)] if upstream else windows[:, size - len(pam) :]
            yield pa.RecordBatch.from_arrays([b.column("contig").take(pa.array(row)), pa.array(STRANDS).take(pa.array(strand)), pa.array(pos), strings(windows), strings(own)], names=["contig", "strand", "pos", "window", "pam"])

    return _cut(contigs, size, chunk).mapInArrow(run, WINDOWS)


def protospacer(windows: DataFrame, pam_length: int, upstream: bool = False) -> DataFrame:
    """``windows`` with ``protospacer``: the window without its PAM, all that an alignment reads."""
    n = F.length("window") - pam_length
    own = F.substring(F.col("window"), F.lit(pam_length + 1), n) if upstream else F.substring(F.col("window"), F.lit(1), n)
    return windows.withColumn("protospacer", own)


def window_groups(windows: DataFrame, key: str = "protospacer") -> DataFrame:
    """``key, n``: each distinct protospacer and how often it occurs; counted before the shuffle, so a frequent one is cheap."""
    return windows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def window_statistics(windows: DataFrame, key: str = "protospacer") -> DataFrame:
    """One row: ``hits, unique_windows``."""
    return window_groups(windows, key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("unique_windows"))


def expand(windows: DataFrame, alignments: DataFrame, key: str = "protospacer") -> DataFrame:
    """Each occurrence with each alignment of its protospacer; occurrences without any go."""
    return windows.join(alignments, key, "inner")


def search_hits(contigs: DataFrame, guides: list[str], pam: str, caps: Thresholds, upstream: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Occurrences with their alignments (see HITS): the rows of ``expand(scan_windows, align)``, without a shuffle.

    Windows are aligned in the task that finds them. The windows of a group of chunks are aligned once each, so
    repeats cost little, and only hits leave the task: far fewer rows than windows.
    """
    pam, size = check(pam), window_size(len(guides[0]), pam, caps)
    names = [c.split()[0] for c in HITS.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b, row, strand, pos, windows in _found(batches, pam, size, upstream):
            inner = windows[:, len(pam) :] if upstream else windows[:, : size - len(pam)]
            first, of = _distinct(inner)
            order = np.argsort(of, kind="stable")
            begins = np.searchsorted(of[order], np.arange(len(first) + 1))
            for g in guides:
                got = align_matrix(inner[first], g, caps, upstream)
                if not got:
                    continue
                uniq, cols = got
                times = begins[uniq + 1] - begins[uniq]
                which = np.repeat(np.arange(len(uniq)), times)
                inside = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                at = order[begins[uniq][which] + inside]
                n = len(at)
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [b.column("contig").take(pa.array(row[at])), pa.array(STRANDS).take(pa.array(strand[at])), pa.array(pos[at]), strings(windows[at]), pa.repeat(g, n), *(c.take(take) for c in cols)],
                    names=names,
                )

    return _cut(contigs, size, chunk).mapInArrow(run, HITS)
