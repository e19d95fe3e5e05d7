import hashlib
import os
import re
import shutil
import time
from collections import defaultdict

import numpy as np
import pytest

from loomseq.llm import queries
from loomseq.llm.common import Scratch
from loomseq.llm.exact_dedup import exact_dedup, merge_runs
from loomseq.llm.line_dedup import line_dedup
from loomseq.llm.near_dedup import agree, components, least_matches, near_duplicates, sketch

from .conftest import duck, rows_of


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert rows_of(got) == duck(queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_by_hand(spark, odd, fan_in):
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in data:
        groups[normal(t)].append(i)
    want = []
    for i, t in data:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[normal(t)]), i is not None and i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(odd.repartition(7), fan_in=fan_in).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("fan_in, rounds", [(2, 5), (3, 3), (8, 2)])
def test_runs_are_merged_by_sort_aggregates(spark, fan_in, rounds):
    rng = np.random.default_rng(fan_in)
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 500)), f"d{rng.integers(0, 40)}", int(rng.integers(0, 2)), 7, int(r)) for r in rng.integers(0, 20, 400)]
    out = merge_runs(spark.createDataFrame(rows, "doc_id long, text_sha256 string, _n int, _x long, _run int"), 20, fan_in)
    want = defaultdict(list)
    for i, d, n, x, _ in rows:
        want[d, n, x].append(i)
    got = {(r["text_sha256"], r["_n"], r["_x"]): (r["keep_id"], r["group_size"]) for r in out.collect()}
    assert got == {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in want.items()}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 2 * rounds and "HashAggregate" not in plan


def test_empty(nothing):
    assert exact_dedup(nothing).count() == line_dedup(nothing).count() == near_duplicates(nothing).count() == 0


def lines_by_hand(data, window=3):
    first = {}
    docs = sorted((i, (t or "").split("\n")) for i, t in data)
    count = defaultdict(int)
    for i, lines in docs:
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            count[key] += 1
            first.setdefault(key, (i, p))
    out = {}
    for i, lines in docs:
        gone = set()
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            if count[key] > 1 and first[key] != (i, p):
                fi, fp = first[key]
                gone |= set(range(max(p, fp + window) if fi == i else p, p + window))
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone), sorted(gone))
    return out


def test_lines_by_hand(spark):
    rng = np.random.default_rng(4)
    data = [(i, "\n".join(rng.choice(list("abc"), rng.integers(0, 9)))) for i in range(40)] + [(90, None), (91, "a\na\na\na\na\na"), (92, "")]
    want = lines_by_hand(data)
    for r in line_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect():
        n, k, text, gone = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["text"]) == (n, k, text)
        assert [x for s in r["spans"] for x in range(s["first"], s["last"] + 1)] == gone


def lines_by_row(data, window=3):
    """The same for rows, of which several may share an identifier: (doc_id, n_lines, n_removed, text) of each."""
    ranked = sorted(((i, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), n, (t or "").split("\n")) for n, (i, t) in enumerate(data) if i is not None))
    first, count, out = {}, defaultdict(int), []
    for i, m, n, lines in ranked:
        for p in range(len(lines) - window + 1):
            count[tuple(lines[p : p + window])] += 1
            first.setdefault(tuple(lines[p : p + window]), (n, p))
    for n, (i, t) in enumerate(data):
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - window + 1) if i is not None else ():
            key = tuple(lines[p : p + window])
            if first[key] != (n, p):
                gone |= set(range(max(p, first[key][1] + window) if first[key][0] == n else p, p + window))
        out.append((i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def test_lines_of_rows_that_share_an_identifier(spark, tmp_path):
    shared, own = [f"s{i}" for i in range(4)], [f"u{i}" for i in range(5)]
    data = [(1, "\n".join(shared)), (2, "\n".join([*shared, "x", "y"])), (2, "\n".join(own))]
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr)
    assert got == lines_by_row(data) and (2, 5, 0, "\n".join(own)) in got
    rng = np.random.default_rng(8)
    data = [(int(rng.integers(0, 6)) or None, "\n".join(rng.choice(list("abc"), rng.integers(0, 12)))) for _ in range(60)]
    data += data[:10]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup(docs.repartition(4)).select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr)
    assert got == lines_by_row(data)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    os.rename(next(str(p) for p in (tmp_path / "documents.parquet").glob("*.parquet")), f"{tmp_path}/one")
    shutil.rmtree(tmp_path / "documents.parquet")
    os.rename(f"{tmp_path}/one", f"{tmp_path}/documents.parquet")
    assert rows_of(queries.QUERIES["op5_line_dedup"](spark, str(tmp_path))) == duck(queries.ORACLE_SQL["op5_line_dedup"], str(tmp_path))


def test_lines_of_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(19_998))
    every_other = "\n".join(f"line {i}" if i % 9 < 5 else f"own {i}" for i in range(19_998))
    spark.range(1).count()
    began = time.monotonic()
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame([(1, text), (2, text), (3, every_other)], "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 60
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["text"], len(got[2]["spans"])) == (0, 19_998, "", 1)
    assert got[3]["n_removed"] == sum(i % 9 < 5 for i in range(19_998)) and got[3]["text"] == "\n".join(f"own {i}" for i in range(19_998) if i % 9 >= 5)


def test_lines_odd(odd):
    got = line_dedup(odd).collect()
    assert len(got) == odd.count()
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)


def shingles_by_hand(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_by_hand(data, k, percent):
    sets = [(i, shingles_by_hand(t, k)) for i, t in data]
    comp = {}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    nodes = [n for n, (i, s) in enumerate(sets)]
    comp = {n: n for n in nodes}
    for a in nodes:
        for b in nodes[:a]:
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                comp[find(a)] = find(b)
    least = defaultdict(list)
    for n in nodes:
        least[find(n)].append(sets[n][0])
    return [(sets[n][0], len(sets[n][1]), min(least[find(n)])) for n in nodes]


def edited(rng, words, share, vocabulary):
    words = list(words)
    for k in rng.choice(len(words), int(share * len(words)), replace=False):
        words[k] = str(rng.choice(vocabulary))
    return words


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_by_hand(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(500)]
    data = []
    for g in range(30):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 300))))
        for c in range(int(rng.integers(1, 12))):
            data.append((1000 * g + c, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03, 0.06]), vocabulary))))
    for c in range(60):  # one large group, all about as similar as the limit
        data.append((50_000 + c, " ".join(edited(rng, base, 0.025, vocabulary))))
    data += [(-1, None), (-2, ""), (-3, "  \n"), (-4, "One two"), (-5, "one  TWO"), (-6, "one")]
    rng.shuffle(data)
    data = [(int(i), t) for i, t in data]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(6), shingle=k, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(near_by_hand(data, k, percent))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_chains(spark):
    chains = [(100 * n + k + 1, 100 * n + k) for n in range(3, 11) for k in range(1, n)]
    triangle = [(2, 1), (3, 2), (3, 1)]
    for name, links in {"two": [(3, 2), (2, 1)], "chains": chains, "triangle": chains + triangle}.items():
        got = components(Scratch(spark, "chains"), spark.createDataFrame(links, "a long, b long"), name).collect()
        assert {r["id"]: r["comp"] for r in got} == {x: x // 100 * 100 + 1 for link in links for x in link}


def test_near_hub_of_many_slices(spark, monkeypatch):
    from loomseq.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SLICE", 4)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = list(rng.choice(vocabulary, 200))
    data = [(c, " ".join(edited(rng, base, 0.01 if c % 3 else 0.2, vocabulary))) for c in range(80)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=3, percent=85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(near_by_hand(data, 3, 85))


def test_near_chain_of_texts(spark):
    data = [(n * 100 + k, " ".join(f"w{n}-{i}" for i in range(8 * k, 8 * k + 100))) for n in range(3, 11) for k in range(n)]
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), shingle=3, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 100 * 100 for i, _ in data}


def test_near_odd(odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] is None:
            assert not r["kept"] and (r["component_id"] == 4 or r["n_shingles"] == 0)
        elif r["n_shingles"] == 0:
            assert r["component_id"] == r["doc_id"]
    by_id = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got}
    assert by_id[5, 1] == 4 and by_id[7, 1] == 6
    assert {c for (i, _), c in by_id.items() if i in (9, 10)} == {9}


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(0)
    least, lost, passed = least_matches(85), 0, 0
    for n in (20, 100, 400, 2000):
        for _ in range(60):
            c = int(np.ceil(2 * n * 0.85 / 1.85))
            for common, similar in ((c, True), (c // 2, False)):
                base = rng.integers(0, 2**63, common, dtype=np.uint64)
                x, y = (np.unique(np.concatenate([base, rng.integers(0, 2**63, n - common, dtype=np.uint64)])) for _ in "xy")
                good = [len(agree(sketch(x, b), sketch(y, b)[None], len(x), np.array([len(y)]), least, 85)[0]) for b in (128, 512)]
                lost += similar and not all(good)
                passed += not similar and all(good)
    assert lost <= 2 and passed == 0
