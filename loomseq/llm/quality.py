"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import documents
from loomseq.llm.textnp import SPACE, frugal, mix, slices, words

#: Most labelled rows that a model is fitted on; over it, those of the smallest hash of their identifier.
MAX_TRAIN = 6000
DIMS = 1 << 15
RANK = 6
EPOCHS = 12
THRESHOLD = 0.3
_BINS = 16
SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    """``w0 + w.x + 1/2 sum_f ((v_f.x)^2 - v_f^2.x^2)``: the pairs' sum in time linear in a text's distinct features."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, text: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(text, self.w[index] * value, n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            vx = self.v[index, f] * value
            pairs += np.bincount(text, vx, n) ** 2 - np.bincount(text, vx * vx, n)
        return self.w0 + linear + 0.5 * pairs


def _ratio_bin(x: np.ndarray) -> np.ndarray:
    """0 for none, then bins that halve towards 0, up to _BINS - 1 for nearly all."""
    with np.errstate(divide="ignore"):
        return np.where(x <= 0, 0, np.clip(_BINS - 1 + np.floor(np.log2(np.maximum(x, 1e-9)) * 1.5), 1, _BINS - 1)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of texts in a row: each distinct hashed word with its share of the words, under its square root, and one feature for each statistic's bin."""
    n = len(offsets) - 1
    h, starts, ends, of = words(data, offsets)
    count = np.bincount(of, minlength=n).astype(np.float64)
    lens = np.diff(offsets).astype(np.float64)
    with np.errstate(over="ignore"):
        key = (of.astype(np.uint64) << np.uint64(32)) | (h % np.uint64(DIMS - 1024))
    uniq, times = np.unique(key, return_counts=True)
    text = (uniq >> np.uint64(32)).astype(np.int64)
    index = (uniq & np.uint64(0xFFFFFFFF)).astype(np.int64)
    value = np.sqrt(times / count[text])

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(lens, 1)

    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    mark = ~(upper | digit | lower | SPACE[data] | (data >= 128))
    distinct = np.bincount(text, minlength=n) / np.maximum(count, 1)
    word_len = np.bincount(of, ends - starts, n) / np.maximum(count, 1)
    pairs = np.zeros(n)
    if len(h) > 1:  # share of word pairs that occurred before in the text
        same = of[1:] == of[:-1]
        with np.errstate(over="ignore"):
            pk = np.unique((of[1:][same].astype(np.uint64) << np.uint64(40)) | (mix(h[:-1][same] * np.uint64(3) ^ h[1:][same]) & np.uint64((1 << 40) - 1)))
        kinds = np.bincount((pk >> np.uint64(40)).astype(np.int64), minlength=n)
        pairs = 1 - kinds / np.maximum(np.bincount(of[1:][same], minlength=n), 1)
        pairs[count < 2] = 0
    stats = [share(upper), share(digit), share(mark), share(data >= 128), share(data == 10), distinct, pairs, share(data == 124), share(data == 46), share((data == 33) | (data == 63))]
    bins = [_ratio_bin(s) for s in stats]
    bins.append(np.clip(word_len * 1.5, 0, _BINS - 1).astype(np.int64))
    bins.append(np.clip(np.log2(lens + 1), 0, _BINS - 1).astype(np.int64))  # the length that n_chars tells as metadata, of the text itself
    rows = np.arange(n)
    base = DIMS - 1024
    text = np.concatenate([text, *[rows] * len(bins)])
    index = np.concatenate([index, *[base + k * _BINS + b for k, b in enumerate(bins)]])
    value = np.concatenate([value, np.full(n * len(bins), 0.5)])
    return text, index, value


def fit(text: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.15, shrink: float = 1e-5, seed: int = 7) -> Model:
    """Logistic loss by AdaGrad over small batches, in an order that the seed fixes. Both labels weigh alike."""
    rng = np.random.default_rng(seed)
    n = len(label)
    order = np.argsort(text, kind="stable")
    text, index, value = text[order], index[order], value[order]
    firsts = np.searchsorted(text, np.arange(n + 1))
    w0, w, v = 0.0, np.zeros(DIMS), rng.normal(0, 0.02, (DIMS, rank))
    g0, gw, gv = 1e-8, np.full(DIMS, 1e-8), np.full((DIMS, rank), 1e-8)
    good = max(1, int(label.sum()))
    bad = max(1, n - good)
    weight = np.where(label > 0, n / (2 * good), n / (2 * bad))
    for _ in range(epochs):
        shuffled = rng.permutation(n)
        for k in range(0, n, 64):
            own = shuffled[k : k + 64]
            take = np.concatenate([np.arange(firsts[i], firsts[i + 1]) for i in own])
            t = np.repeat(np.arange(len(own)), [firsts[i + 1] - firsts[i] for i in own])
            i, x = index[take], value[take]
            used, at = np.unique(i, return_inverse=True)
            vi = v[i]
            vx = vi * x[:, None]
            sums = np.stack([np.bincount(t, vx[:, f], len(own)) for f in range(rank)], 1)
            squares = np.stack([np.bincount(t, vx[:, f] ** 2, len(own)) for f in range(rank)], 1)
            m = w0 + np.bincount(t, w[i] * x, len(own)) + 0.5 * (sums**2 - squares).sum(1)
            d = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - label[own]) * weight[own] / len(own)
            dw = np.bincount(at, d[t] * x, len(used)) + shrink * w[used]
            dv = (d[t] * x)[:, None] * (sums[t] - vx)
            dv = np.stack([np.bincount(at, dv[:, f], len(used)) for f in range(rank)], 1) + shrink * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            d0 = float(d.sum())
            g0 += d0**2
            w0 -= rate * d0 / g0**0.5
    return Model(w0, w, v)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, **how) -> Model:
    """Fit on labelled documents that aren't held out: crc32 of the identifier as text, mod 5, is not 0. Bounded by ``max_train`` rows, taken by the smallest hash of the identifier; the driver holds these alone. Without both labels, every score is the labels' mean."""
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("doc_id", "y", "text")

    def pull(batches):
        import pyarrow as pa

        for b in batches:
            y, ids = np.array(b.column("y").to_pylist()), b.column("doc_id").to_pylist()
            for first, data, offsets in slices(b.column("text")):
                t, i, x = features(data, offsets)
                order = np.argsort(t, kind="stable")
                cuts = np.searchsorted(t[order], np.arange(1, len(offsets) - 1))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first : first + n], pa.int64()), pa.array(y[first : first + n], pa.int32()), pa.array([p.astype("<i4").tobytes() for p in np.split(i[order], cuts)], pa.binary()), pa.array([p.astype("<f4").tobytes() for p in np.split(x[order], cuts)], pa.binary())],
                    names=["doc_id", "y", "i", "x"],
                )

    rows = sorted(got.mapInArrow(frugal(pull), "doc_id long, y int, i binary, x binary").collect(), key=lambda r: r["doc_id"])
    label = np.array([r["y"] for r in rows], np.float64)
    if len(np.unique(label)) < 2:
        p = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
        return Model(float(np.log(p / (1 - p))), np.zeros(DIMS), np.zeros((DIMS, 1)))
    index = [np.frombuffer(r["i"], "<i4") for r in rows]
    text = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    return fit(text, np.concatenate(index).astype(np.int64), np.concatenate([np.frombuffer(r["x"], "<f4") for r in rows]).astype(np.float64), label, **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    The score is of the whole text alone and grows with the chance of label 1. Null and empty texts are scored by
    their statistics. Null identifiers aren't held out. Repeated rows give repeated rows, an empty table an empty
    result, and other columns are not read. The model (fixed size) travels with the tasks.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for b in batches:
            for first, data, offsets in slices(b.column("text")):
                n = len(offsets) - 1
                z = m.margin(*features(data, offsets), n)
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, n), b.column("held_out").slice(first, n), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(frugal(run), SCORED)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more. Null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def run(batches):
        import pyarrow as pa

        m = Model(*shared.value)
        for b in batches:
            good = []
            for first, data, offsets in slices(b.column(text_col)):
                z = m.margin(*features(data, offsets), len(offsets) - 1)
                good += (first + np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold)).tolist()
            yield b.take(pa.array(good, pa.int64()))

    return docs.mapInArrow(frugal(run), docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL: dict[str, str] = {}
