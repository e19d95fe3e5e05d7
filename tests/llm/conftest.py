import datetime

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, id string, val binary, _t string, n_tokens string, copies string, size string, bucket long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows and identifiers, and extra columns whose names operators use themselves."""
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "Gamma", "delta.", "MIT", "license", "été", "日本語", "x", "42"]
    long = " ".join(rng.choice(words, 30_000)) + "\nend\nend\nend\nend"
    texts = [None, "", " ", "\n\n\n", "one", "one", "one  two", "one two", "a\x00b \U0001f600", long, long, "MIT License\nline\nline\nline\nline", "cc by gnu general public license apache license"]
    rows = [(i, t, ["s", None, "t"][i % 3]) for i, t in enumerate(texts)] + [(None, "one", "s"), (None, None, None), (4, "one", "s"), (4, "other text of four", "t"), (-7, "one two three four five six", "s")]
    return spark.createDataFrame([(*r, "c", b"c", "c", "c", "c", "c", 1) for r in rows], DOCS)


@pytest.fixture
def nothing(odd):
    return odd.limit(0)


def plain(v):
    return v.isoformat() if isinstance(v, datetime.datetime) else bytes(v) if isinstance(v, bytearray) else v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck(sql, sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
