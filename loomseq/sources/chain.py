"""Chain files as a table of aligned blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.schemas import CHAIN_BLOCKS


def parse_chain(text: str | Iterable[str]) -> Iterator[tuple]:
    """Rows of CHAIN_BLOCKS from a file's text or its lines, which are read one by one. Blocks of a reverse query are given on its forward strand. Wrong headers, data outside a chain, and blocks that don't fill the header's spans are errors with the line."""
    head, t, q, last, order = None, 0, 0, False, 0

    def wrong(n: int, what: str):
        return ValueError(f"chain file, line {n}: {what}")

    def end(n: int):
        if head and not (last and t == head[4] and q == head[8]):
            raise wrong(n, "the blocks don't fill the header's spans")

    n = 0
    for n, line in enumerate(text.splitlines() if isinstance(text, str) else text, 1):
        f = line.split()
        if not f or f[0].startswith("#"):
            continue
        if f[0] == "chain":
            end(n)
            if len(f) not in (12, 13) or f[4] != "+" or f[9] not in "+-":
                raise wrong(n, "not a chain header")
            try:
                score, t_size, t0, t1, q_size, q0, q1 = (int(f[i]) for i in (1, 3, 5, 6, 8, 10, 11))
                name = int(f[12]) if len(f) == 13 and f[12].isdigit() else order
            except ValueError:
                raise wrong(n, "not a number in a chain header") from None
            if not (0 <= t0 <= t1 <= t_size and 0 <= q0 <= q1 <= q_size):
                raise wrong(n, "a span beyond its sequence")
            head, t, q, last = (name, score, f[2], f[7], t1, q_size, f[9], order, q1), t0, q0, False
            order += 1
            continue
        if head is None or last:
            raise wrong(n, "data outside a chain")
        if len(f) not in (1, 3):
            raise wrong(n, "a data line has one or three fields")
        try:
            size, dt, dq = (int(x) for x in (*f, 0, 0)[:3])
        except ValueError:
            raise wrong(n, "not a number") from None
        if min(size, dt, dq) < 0 or t + size > head[4] or q + size > head[8]:
            raise wrong(n, "the blocks don't fill the header's spans")
        begin = q if head[6] == "+" else head[5] - (q + size)
        yield (head[0], head[1], head[2], t, t + size, head[3], begin, begin + size, head[6], head[7])
        t, q, last = t + size + dt, q + size + dq, len(f) == 1
    end(n)


def read_chain(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CHAIN_BLOCKS and ``file`` of chain files, plain or gzip; one task parses a file, as its coordinates run on from line to line. Python gets the lines batch by batch and never a whole file."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in CHAIN_BLOCKS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in CHAIN_BLOCKS.split(", ")]
        def lines():
            n = 0
            for b in batches:
                for at, value, file in zip(*(b.column(c).to_pylist() for c in ("at", "value", "file")), strict=True):
                    n += at == 0
                    yield n, file, value

        def flush(rows, file):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.repeat(file, len(rows))], names=[*names, "file"])

        for (_, file), own in groupby(lines(), lambda x: x[:2]):
            rows: list[tuple] = []
            for row in parse_chain(line for x in own for line in x[2].splitlines() or [""]):
                rows.append(row)
                if len(rows) >= 10_000:
                    yield flush(rows, file)
                    rows = []
            if rows:
                yield flush(rows, file)

    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value"), F.col("_metadata.file_path").alias("file"))
    return text.mapInArrow(run, CHAIN_BLOCKS + ", file string")


def blocks_from_steps(chains: DataFrame, steps: DataFrame) -> DataFrame:
    """CHAIN_BLOCKS from headers and steps that are tables already: each block begins where the sizes and gaps before it in its chain end.

    ``chains``: ``chain_id, score, t_name, t_start, q_name, q_size, q_start, q_strand, file_order``; ``steps``:
    ``chain_id, step_no, size, dt, dq``. A chain is one window, as its sums run along it.
    """
    before = Window.partitionBy("chain_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    run = steps.select("chain_id", "step_no", "size", F.coalesce(F.sum(F.col("size") + F.col("dt")).over(before), F.lit(0)).alias("_t"), F.coalesce(F.sum(F.col("size") + F.col("dq")).over(before), F.lit(0)).alias("_q"))
    joined = run.join(chains, "chain_id")
    t = F.col("t_start") + F.col("_t")
    q = F.col("q_start") + F.col("_q")
    begin = F.when(F.col("q_strand") == "+", q).otherwise(F.col("q_size") - (q + F.col("size")))
    return joined.select("chain_id", "score", "t_name", t.alias("t_start"), (t + F.col("size")).alias("t_end"), "q_name", begin.alias("q_start"), (begin + F.col("size")).alias("q_end"), "q_strand", "file_order")


def ranked_chains(blocks: DataFrame, by: tuple[str, ...] = ("t_name",)) -> DataFrame:
    """``t_name, chain_id, score, rank``: the chains of each target by score, then in the file's order."""
    chains = blocks.groupBy(*by, "chain_id", "file_order").agg(F.max("score").alias("score"))
    return chains.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "file_order")))
