"""Packing token ids into sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import documents
from loomseq.llm.textnp import frugal, slices

CAPACITY = 2048
END_ID = 1
#: Windows in a block that is differenced as one; a block's pieces are all that a task keeps.
BLOCK_WINDOWS = 128
#: Pieces after which a block is differenced even if it fills fewer windows, so that tiny texts don't make it large.
BLOCK_PIECES = 1 << 14
#: Longest piece of what a document has beyond its full sequences.
PIECE = 512
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """A window from 0 up to k for each size, by the largest differencing method in k ways.

    Every size starts as a partial partition of its own: k slots, one of them filled. The two partial partitions of
    the largest imbalance (fullest less emptiest slot) are merged, fullest slots onto emptiest, until one is left. A
    partial partition keeps its slots sorted, so a merge is one addition and one sort; which slots met is remembered
    and followed back at the end.
    """
    n = len(sizes)
    out = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return out
    slots: list = [None] * n  # sorted, from the fullest to the emptiest
    for i, x in enumerate(sizes):
        s = np.zeros(k, np.int64)
        s[0] = x
        slots[i] = s
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        s = slots[a] + slots[b][::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        slots[a] = slots[b] = None
        made.append((a, b, order))
        slots.append(s)
        heapq.heappush(heap, (-int(s[0] - s[-1]), len(slots) - 1))
    where: dict[int, np.ndarray] = {len(slots) - 1: np.arange(k)}
    for i in range(len(made) - 1, -1, -1):
        a, b, order = made[i]
        at = where.pop(n + i)
        back = np.empty(k, np.int64)
        back[order] = at  # the window of each slot before the sort
        for part, windows in ((a, back), (b, back[::-1])):
            if part < n:
                out[part] = windows[0]
            else:
                where[part] = windows
    return out


def assign(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A window for each size, none over capacity: as few windows as hold the total, one more whenever one is exceeded."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return window, k
        k += 1


def pieces_of(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length): full sequences first, then the rest in pieces."""
    full = n // capacity * capacity
    return [(i, capacity) for i in range(0, full, capacity)] + [(i, min(piece, n - i)) for i in range(full, n, piece)]


def _packer(path: str, capacity: int, end_id: int, piece: int, block_windows: int):
    def pack_part(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from loomseq.llm.encoding import encoder

        enc = encoder(path)
        part = TaskContext.get().partitionId()
        state = {"next": part << 32}
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]

        def emit(rows: list[tuple]):
            cols = [np.array(c, dtype=object) if None in c else np.array(c, np.int64) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def block(rest: list[tuple]):
            sizes = np.array([r[2] for r in rest], np.int64)
            window, k = assign(sizes, capacity)
            used = np.zeros(k, np.int64)
            offsets = np.zeros(len(rest), np.int64)
            for i, w in enumerate(window):
                offsets[i] = used[w]
                used[w] += sizes[i]
            first = state["next"]
            state["next"] += k
            return [(*r, int(first + w), int(o), int(used[w])) for r, w, o in zip(rest, window, offsets, strict=True)]

        rest: list[tuple] = []
        held = 0
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                ids, at = enc.encode_bytes(data, offsets)
                rows: list[tuple] = []
                for j in range(len(offsets) - 1):
                    own = np.append(ids[at[j] : at[j + 1]], end_id).astype("<u4")
                    n = len(own)
                    for start, length in pieces_of(n, capacity, piece):
                        row = (ids_of[first + j], start, length, zlib.crc32(own[start : start + length].tobytes()), n)
                        if length == capacity:
                            rows.append((*row, state["next"], 0, capacity))
                            state["next"] += 1
                        else:
                            rest.append(row)
                            held += length
                    if held >= block_windows * capacity or len(rest) >= BLOCK_PIECES:
                        rows += block(rest)
                        rest, held = [], 0
                if rows:
                    yield emit(rows)
        if rest:
            yield emit(block(rest))

    return pack_part


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, piece: int = PIECE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids, one row a piece (see SCHEMA).

    A document is the ids of its whole text, then ``end_id``. As many full sequences as it holds are cut from its
    start; the rest, in pieces of at most ``piece`` ids, waits with others of its partition until they fill a block of
    ``block_windows`` windows or are BLOCK_PIECES, which Karmarkar-Karp differencing balances. The number of windows is the least that
    holds the block, and rises by one as long as any window is over capacity. Blocks are independent: no shuffle, and
    a task keeps one block of piece sizes, never ids. ``sequence_length`` tells how much of a sequence is filled.
    Null and empty texts are just the end id. Null or repeated identifiers are packed like others. An empty table
    gives no pieces. Other columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(_packer(path, capacity, end_id, piece, block_windows)), SCHEMA)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
