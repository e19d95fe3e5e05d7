import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomseq.operators.align import Thresholds
from loomseq.plans import catalog, genome
from loomseq.streaming.sessions import stream_clusters, stream_search

from .test_align import brute

SF = "/root/testdata/sf0.001"


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.ORACLE_SQL[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


def test_bulges_by_recursion(spark):
    """All scripts of the windows that have any, against recursion. That no window is missed, the tests of the aligner show."""
    caps = Thresholds(4, 1, 1)
    got = {}
    for r in genome.align_bulges(spark, SF).collect():
        got.setdefault((r["guide"], r["protospacer"]), set()).add((r["offset"], r["ops"]))
    assert got
    for (guide, window), scripts in list(got.items()):
        assert scripts == brute(guide, window, caps)


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_stream(spark, tmp_path):
    rows = [(1, 0), (1, 10), (1, 21), (2, 5), (1, 500)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "user int, s long").selectExpr("user", "timestamp_seconds(s) AS ts").write.parquet(src)
    stream = stream_clusters(spark.readStream.schema("user int, ts timestamp").parquet(src), ["user"], "ts", "10 seconds", "0 seconds")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    assert query.awaitTermination(120)
    got = sorted((r["user"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # the newest run is still open

    from loomseq.search import search

    batches = []
    spark.createDataFrame([("c", "CTAACAGTTGCTTTTATCACTGG")], "contig string, seq string").write.parquet(str(tmp_path / "contigs"))
    contigs = spark.readStream.schema("contig string, seq string").parquet(str(tmp_path / "contigs"))
    q = stream_search(contigs, lambda b: search(b, "CTAACAGTTGCTTTTATCAC", "NGG", Thresholds(0)), lambda rows, n: batches.append((n, rows.count())), str(tmp_path / "cp2"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert (0, 1) in batches
