"""Window files in binary: rows of a fixed width, and lists of positions."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.alphabet import MASK

_TEXT = {m: c for c, m in MASK.items() if c != "U"}


def encode_windows(windows: list[str]) -> bytes:
    """One byte per base: the mask of the bases that its code stands for."""
    return b"".join(bytes(MASK[c] for c in w) for w in windows)


def encode_positions(positions: list[list[int]]) -> bytes:
    """For each row its number of positions and the positions, as little-endian 32-bit integers."""
    return b"".join(struct.pack(f"<I{len(p)}I", len(p), *p) for p in positions)


def read_windows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``idx, window`` of a file of fixed-width rows. A size that ``width`` does not divide is an error."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for content in b.column("content"):
                raw = content.as_py()
                if len(raw) % width:
                    raise ValueError(f"{len(raw)} bytes are no rows of {width}")
                for k in range(0, len(raw), width * 65_536):
                    part = raw[k : k + width * 65_536]
                    n = len(part) // width
                    text = ["".join(_TEXT.get(x, "N") for x in part[i * width : (i + 1) * width]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(k // width, k // width + n), pa.int64()), pa.array(text)], names=["idx", "window"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "idx long, window string")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """``idx, position``: one row per position of each list. A list cut short is an error."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for content in b.column("content"):
                raw = np.frombuffer(content.as_py(), "<u4")
                at, idx, ids, out = 0, 0, [], []
                while at < len(raw):
                    n = int(raw[at])
                    if at + 1 + n > len(raw):
                        raise ValueError("a list of positions is cut short")
                    ids.append(np.full(n, idx, np.int64))
                    out.append(raw[at + 1 : at + 1 + n].astype(np.int64))
                    at, idx = at + 1 + n, idx + 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(out))], names=["idx", "position"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "idx long, position long")


def read_dataset(spark: SparkSession, windows: str, positions: str, width: int) -> DataFrame:
    """``idx, window, position``: both files, joined by the row's number."""
    return read_windows(spark, windows, width).join(read_positions(spark, positions), "idx")


def write_windows(windows: DataFrame, path: str, column: str = "window") -> None:
    """Windows as Parquet, which keeps them in columns."""
    windows.select(F.col(column)).write.mode("overwrite").parquet(path)
