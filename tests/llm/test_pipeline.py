from collections import Counter, defaultdict
from math import floor

import pytest

import corpus_pipeline
from loomseq.llm import mixing
from loomseq.llm.mixing import offset, targets
from loomseq.llm.quality import score, train

from .test_dedup import near_by_hand, normal
from .test_tokens import WORD, library


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents and what each stage keeps of them, written and read again as in a run."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = score(stages[0], train(stages[0], labels)).where("predicted = 1")
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(i for i, _ in pairs(stages[1]))


def test_exact_stage(stages):
    first = {}
    for i, t in sorted(pairs(stages[1])):
        first.setdefault(normal(t), i)
    assert sorted(first.values()) == sorted(i for i, _ in pairs(stages[2]))


def test_near_stage(stages):
    data = pairs(stages[2])
    want = sorted(i for i, _, c in near_by_hand(data, 5, 80) if i == c)
    assert want == sorted(i for i, _ in pairs(stages[3]))


def test_mix_stage(stages):
    rows = [(r["source"], len([w for w in normal(r["text"]).split(" ") if w]), r["doc_id"]) for r in stages[3].collect()]
    sizes = defaultdict(int)
    for s, n, _ in rows:
        sizes[s] += n
    want, by, rank = targets(list(sizes.items())), Counter(), Counter()
    for s, n, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        rank[s] += 1
        rate = want[s] / sizes[s] if sizes[s] else 0.0
        by[i] += floor(offset(s) + rate * rank[s]) - floor(offset(s) + rate * (rank[s] - 1))
    got = Counter(i for i, _ in pairs(stages[4]))
    assert +got == +by


def test_packing_stage(stages):
    t = library(WORD)
    want = Counter()
    for i, text in pairs(stages[4]):
        want[i] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in stages[5].collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert got == want and max(fill.values()) <= 2048


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").drop("sequence_id", "offset", "sequence_length").count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


LONG = " ".join(f"w{i}" for i in range(100))
ROWS = "doc_id long, text string, source string"


def test_rows_without_identifier(spark):
    docs = spark.createDataFrame([(None, LONG, "s"), (None, LONG + " more", "s"), (None, "alone of all", "t"), (None, "alone of all", "t"), (3, "with a name", "s"), (None, "with a name", "s")], ROWS)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert sorted(map(str, pairs(exact))) == sorted(map(str, [(None, LONG), (None, LONG + " more"), (None, "alone of all"), (3, "with a name")]))
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert len(pairs(near)) == 3 and (None, "alone of all") in pairs(near) and (3, "with a name") in pairs(near)
    assert (None, "alone of all") in pairs(corpus_pipeline.mix_sources(spark, near, ""))


def test_rows_that_share_an_identifier(spark):
    docs = spark.createDataFrame([(1, "one text", "s"), (1, "one  text", "s"), (1, "one text", "s"), (2, "one text", "s"), (2, "other text", "t")], ROWS)
    exact = pairs(corpus_pipeline.drop_exact_copies(spark, docs, ""))
    assert sorted((i, normal(t)) for i, t in exact) == [(1, "one text"), (2, "other text")]
    near = spark.createDataFrame([(1, LONG, "s"), (1, LONG + " more", "s"), (1, "far from it", "s")], ROWS)
    assert len(pairs(corpus_pipeline.drop_near_copies(spark, near, ""))) == 2
    mixed = spark.createDataFrame([(1, "w " * n, "st"[n % 2]) for n in range(1, 9)] + [(1, "w w", "s")] * 3, ROWS)
    want = sum(r["copies"] for r in mixing.mix(mixed).collect())
    assert len(pairs(corpus_pipeline.mix_sources(spark, mixed, ""))) == want
