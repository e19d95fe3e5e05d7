"""All alignments of guides to windows under caps of mismatches, DNA bulges, RNA bulges and edits.

An alignment is an offset and a script over ``=`` (match), ``X`` (mismatch), ``I`` (a target base without a guide
base: DNA bulge) and ``D`` (a guide base without a target base: RNA bulge). It uses up the guide and ends where the
PAM begins; no ``I`` stands before the first guide base. Every such alignment is a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.functions.alphabet import MASK
from loomseq.schemas import ALIGNMENTS

MASKS = np.zeros(256, np.uint8)
for _code, _m in MASK.items():
    MASKS[ord(_code)] = MASKS[ord(_code.lower())] = _m
MATCH, MISMATCH, DNA, RNA, GAP = (ord(c) for c in "=XID-")


@dataclass(frozen=True)
class Thresholds:
    """Caps. ``max_edits`` 0 stands for the sum of the others, and never exceeds it."""

    mm: int
    bdna: int = 0
    brna: int = 0
    max_edits: int = 0

    def __post_init__(self):
        if min(self.mm, self.bdna, self.brna, self.max_edits) < 0:
            raise ValueError("caps can't be negative")

    @property
    def total(self) -> int:
        most = self.mm + self.bdna + self.brna
        return min(self.max_edits, most) if self.max_edits else most

    @property
    def pad(self) -> int:
        """Bases that a window has beyond guide and PAM."""
        return max(self.bdna, self.brna)


def scripts(windows: np.ndarray, guide: bytes, caps: Thresholds):
    """(rows, offset, shape) of every alignment; a shape is a script with ``M`` for match or mismatch.

    ``windows`` is a matrix of text, one row a window, from pad to protospacer. All rows go down the tree of shapes
    together, each branch with the rows that still are within the caps, so a base is compared once per branch for the
    whole batch and a branch without rows ends.
    """
    g, w = MASKS[np.frombuffer(guide, np.uint8)], MASKS[windows]
    n_guide, stop = len(g), w.shape[1]
    cap = caps.total
    pad = stop - n_guide
    columns = [np.ascontiguousarray(w[:, j]) for j in range(stop)]
    for offset in range(max(0, pad - caps.bdna), min(pad + caps.brna, stop) + 1):
        todo = [(0, offset, 0, 0, np.arange(len(w)), np.zeros(len(w), np.int16), b"")]
        while todo:
            i, j, dna, rna, rows, mm, shape = todo.pop()
            if i == n_guide and j == stop:
                yield rows, offset, shape
                continue
            more = (stop - j) - (n_guide - i)  # DNA bulges to come, less RNA bulges to come
            if not -(caps.brna - rna) <= more <= caps.bdna - dna:
                continue
            if i < n_guide and j < stop:
                m = mm + ((columns[j][rows] & g[i]) == 0)
                good = np.flatnonzero((m <= caps.mm) & (m + (dna + rna) <= cap))
                if len(good):
                    todo.append((i + 1, j + 1, dna, rna, rows[good], m[good], shape + b"M"))
            if dna < caps.bdna or rna < caps.brna:
                good = np.flatnonzero(mm + (dna + rna + 1) <= cap)
                if len(good):
                    if i and j < stop and dna < caps.bdna:
                        todo.append((i, j + 1, dna + 1, rna, rows[good], mm[good], shape + b"I"))
                    if i < n_guide and rna < caps.brna:
                        todo.append((i + 1, j, dna, rna + 1, rows[good], mm[good], shape + b"D"))


def strings(matrix: np.ndarray):
    """A matrix of bytes as an Arrow string column, a row each."""
    import pyarrow as pa

    n, k = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix)))


def matrix_of(column) -> np.ndarray:
    """An Arrow string column whose values are all of one length, as a matrix of bytes."""
    n = len(column)
    text = b"".join(x.as_buffer().to_pybytes() for x in column) if n else b""
    return np.frombuffer(text, np.uint8).reshape(n, -1)


def align_matrix(windows: np.ndarray, guide: str, caps: Thresholds, upstream: bool = False):
    """(rows, columns) of all alignments of a guide: window numbers, and Arrow columns offset, ops, rguide, rseq, mm, bdna, brna. None if there are none.

    With the PAM upstream, guide and windows are read backwards, so that alignments again end at the PAM.
    """
    import pyarrow as pa

    g = guide.encode()[::-1] if upstream else guide.encode()
    w = windows[:, ::-1] if upstream else windows
    letters, g_masks = np.frombuffer(g, np.uint8), MASKS[np.frombuffer(g, np.uint8)]
    found: list[tuple] = []
    for rows, offset, shape in scripts(w, g, caps):
        s = np.frombuffer(shape, np.uint8)
        uses_g, uses_w = s != DNA, s != RNA
        gi, wj = np.cumsum(uses_g) - 1, offset + np.cumsum(uses_w) - 1
        both = uses_g & uses_w
        text = np.where(uses_w, w[np.ix_(rows, np.clip(wj, 0, w.shape[1] - 1))], GAP)
        same = (MASKS[text] & np.where(uses_g, g_masks[np.clip(gi, 0, len(g) - 1)], 0)) != 0
        wrong = both & ~same
        ops = np.where(both, np.where(same, MATCH, MISMATCH), s).astype(np.uint8)
        aligned = np.broadcast_to(np.where(uses_g, letters[np.clip(gi, 0, len(g) - 1)], GAP), text.shape).astype(np.uint8)
        text = np.where(wrong, text | 32, text).astype(np.uint8)
        if upstream:
            ops, aligned, text = ops[:, ::-1], aligned[:, ::-1], text[:, ::-1]
        n = len(rows)
        counts = [np.full(n, offset), wrong.sum(1), np.full(n, int((~uses_g).sum())), np.full(n, int((~uses_w).sum()))]
        found.append((rows, strings(ops), strings(aligned), strings(text), *(c.astype(np.int32) for c in counts)))
    if not found:
        return None
    rows, ops, aligned, text, *counts = zip(*found, strict=True)
    offset, mm, bdna, brna = (pa.array(np.concatenate(c)) for c in counts)
    return np.concatenate(rows), [offset, pa.concat_arrays(ops), pa.concat_arrays(aligned), pa.concat_arrays(text), mm, bdna, brna]


def align(protospacers: DataFrame, guides: list[str], caps: Thresholds, column: str = "protospacer", upstream: bool = False) -> DataFrame:
    """``guide, protospacer, offset, ops, rguide, rseq, mm, bdna, brna`` for each guide and each value of ``column``: pad and protospacer, without the PAM.

    Give distinct protospacers and join the result to their occurrences. Values of other lengths than the guides' plus
    ``caps.pad`` are aligned in groups of one length; nulls and values too short for any script have no rows.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            values = b.column(0)
            lengths = pc.binary_length(values)
            for k in pc.unique(lengths).to_pylist():
                if not k:
                    continue
                own = values.filter(pc.equal(lengths, k))
                w = matrix_of(own)
                for g in guides:
                    got = align_matrix(w, g, caps, upstream)
                    if got:
                        rows, cols = got
                        yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows)), own.take(pa.array(rows)), *cols], names=[c.split()[0] for c in ALIGNMENTS.split(", ")])

    return protospacers.select(F.col(column)).mapInArrow(run, ALIGNMENTS)


def hamming(windows: DataFrame, guide: str, column: str = "protospacer", max_mm: int | None = None) -> DataFrame:
    """``windows`` with ``mm``, the mismatches of its protospacer to a guide without bulges: plain Catalyst for text of A, C, G and T, and a filter that is pushed down if ``max_mm`` is given."""
    n = len(guide)
    own = F.right(F.col(column), F.lit(n))
    mm = sum((F.when(F.substring(own, i + 1, 1) == c, 0).otherwise(1) for i, c in enumerate(guide)), F.lit(0))
    out = windows.withColumn("mm", mm.cast("int"))
    return out if max_mm is None else out.where(F.col("mm") <= max_mm)


#: Fixed value: the distance of a window that has an N.
INVALID = 200


def free_end_distance(windows: DataFrame, guide: str, column: str = "protospacer") -> DataFrame:
    """``column, distance``: the least edits that turn the whole guide into any part of each window; INVALID for windows with an N.

    Bases before and after the part are free; a base too many, one too few and a pair without a common code cost one
    each. All windows of a batch go through the table of guide by window at once. Null windows have a null distance,
    empty ones the guide's length.
    """
    codes = MASKS[np.frombuffer(guide.encode(), np.uint8)]

    def distances(w: np.ndarray) -> np.ndarray:
        masks = MASKS[w]
        column_before = np.broadcast_to(np.arange(len(codes) + 1, dtype=np.int16), (len(w), len(codes) + 1)).copy()
        best = column_before[:, -1].copy()
        for t in range(w.shape[1]):
            now = np.zeros_like(column_before)
            for q in range(len(codes)):
                pair = column_before[:, q] + ((masks[:, t] & codes[q]) == 0)
                now[:, q + 1] = np.minimum(np.minimum(now[:, q], column_before[:, q + 1]) + 1, pair)
            best = np.minimum(best, now[:, -1])
            column_before = now
        return np.where((w == ord("N")).any(1) | (w == ord("n")).any(1), INVALID, best)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            values = b.column(0)
            lengths = pc.binary_length(values)
            out = np.zeros(b.num_rows, np.int32)
            for k in pc.unique(lengths.drop_null()).to_pylist():
                at = np.flatnonzero(pc.equal(lengths, k).fill_null(False).to_numpy(zero_copy_only=False))
                out[at] = distances(matrix_of(values.take(pa.array(at)))) if k else len(codes)
            known = values.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([values, pa.array(out, mask=~known)], names=[column, "distance"])

    return windows.select(F.col(column)).mapInArrow(run, f"`{column}` string, distance int")
