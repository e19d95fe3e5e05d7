"""Near-duplicate documents by MinHash bands, sequential Bayesian verification of candidates and an exact check of what survives."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents
from loomseq.llm.textnp import frugal, mix, shingles, slices, words

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 24, 5
#: Bins of the two sketches that candidates are compared by, and how many bins are looked at before each decision.
COARSE, FINE = 128, 512
LOOKS = {COARSE: (64, 128), FINE: (128, 256, 512)}
#: The chance at which a pair that is similar may be given up at a look.
MISS = 1e-4
#: Partners that a document first tries in each bucket; a last round tries all.
FIRST_TRIES = 8
#: Rows of a bucket on either side of a cell, the unit in which sketches are compared.
CELL = 1024
#: Partners of the largest hub that a slice has, on average.
SLICE = 256
#: Documents whose identifiers (8 bytes each) may be broadcast to pick their texts; more go by a shuffle.
BROADCAST_IDS = 1_000_000
#: Draws up to which bounds are tabulated; more only sharpen them.
DRAWS = 4096

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_S = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_SALT = np.uint64(0x5851F42D4C957F2D)


def signature(x: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of BANDS * ROWS functions, uint32."""
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 1024):
            h = (x[k : k + 1024, None] ^ _S[None, :]) * _A[None, :]
            out = np.minimum(out, (h >> np.uint64(32)).min(0).astype(np.uint32))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature (a row each); keys of different bands differ."""
    sig = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[None, :], sig.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key.view(np.int64)


def sketch(x: np.ndarray, bins: int) -> np.ndarray:
    """16 bits of the least member of each bin that a set's hashes are dealt to; 0 where a bin is empty. ``x`` is sorted.

    Equal sets agree in all bins, and of the bins that either set fills, the share in which they agree estimates their
    similarity: each is a draw from the union, none is drawn twice.
    """
    h = np.sort(mix(x ^ _SALT))
    at = (h >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out = np.zeros(bins, np.uint16)
    out[at[first]] = np.maximum((h[first] & np.uint64(0xFFFF)).astype(np.uint16), 1)
    return out


def least_matches(percent: int, miss: float = MISS, draws: int = DRAWS) -> np.ndarray:
    """For each number of draws, the least matches with which a pair goes on: from there the posterior chance that its similarity is at least percent/100 is ``miss`` or more.

    With a uniform prior, that chance after m matches in n draws is that of at most m successes in n + 1 draws of percent/100.
    """
    t, logs = percent / 100, np.cumsum(np.log(np.maximum(np.arange(draws + 3), 1.0)))
    out = np.zeros(draws + 1, np.int64)
    for n in range(1, draws + 1):
        k = np.arange(n + 2)
        pmf = np.exp(logs[n + 1] - logs[k] - logs[n + 1 - k] + k * math.log(t) + (n + 1 - k) * math.log1p(-t))
        out[n] = np.searchsorted(np.cumsum(pmf), miss)
    return out


def agree(left: np.ndarray, right: np.ndarray, n_left, n_right: np.ndarray, least: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``right`` that no look gives up against the row(s) ``left``, and their share of matches. Each batch of bins is compared for those alone that passed the one before.

    As draws aren't put back, u of them out of a union of U tell as much as u / (1 - u/U) that are; U follows from the
    sets' sizes for a pair that is just similar enough.
    """
    t = percent / 100
    sizes = np.broadcast_to(n_left, n_right.shape)
    rows = np.flatnonzero(np.minimum(sizes, n_right) >= t * np.maximum(sizes, n_right) - 1e-9)
    union = (sizes + n_right) / (1 + t)
    matches, drawn, done = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
    for upto in LOOKS[right.shape[1]]:
        x = left[rows, done:upto] if left.ndim == 2 else left[done:upto]
        y = right[rows, done:upto]
        some = (x | y) != 0
        matches = matches + ((x == y) & some).sum(1)
        drawn = drawn + some.sum(1)
        seen = np.minimum(drawn / union[rows], 1 - 1e-6)
        worth = np.clip((drawn / (1 - seen)).astype(np.int64), drawn, len(least) - 1)
        good = matches * worth >= least[worth] * drawn
        rows, matches, drawn, done = rows[good], matches[good], drawn[good], upto
    return rows, matches / np.maximum(drawn, 1)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    n = len(offsets) - 1
    h, _, _, of = words(data, offsets)
    x, t = shingles(h, of, n, k)
    at = np.searchsorted(t, np.arange(n + 1))
    return [np.unique(x[at[i] : at[i + 1]]) for i in range(n)]


SIGNED = "doc_id long, n_shingles long, set_key binary, bands binary, coarse binary, fine binary"


def _sign(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, data, offsets in slices(b.column("text")):
                sets = _sets(data, offsets, k)
                bands = band_keys(np.stack([signature(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(
                            pa.array([made(i, s) if len(s) else None for i, s in enumerate(sets)], pa.binary())
                            for made in (lambda i, s: hashlib.blake2b(s.tobytes(), digest_size=16).digest(), lambda i, s, bands=bands: bands[i].tobytes(), lambda i, s: sketch(s, COARSE).tobytes(), lambda i, s: sketch(s, FINE).tobytes())
                        ),
                    ],
                    names=[c.split()[0] for c in SIGNED.split(", ")],
                )

    return run


def _matrix(column, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _band(batches):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            key = _matrix(b.column("bands"), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], names=["bucket", "id"])


def _texts_to_sets(k: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first, data, offsets in slices(b.column("text")):
                sets = _sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(first, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "val"])

    return run


def _prune(least: np.ndarray, percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (_matrix(b.column(c), np.uint16, b.num_rows) for c in ("ca", "cb"))
                good, _ = agree(x, y, b.column("na").to_numpy(), b.column("nb").to_numpy(), least, percent)
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return run


def _exact(percent: int):
    """Pairs of a slice of a hub's partners whose sets are similar enough. Rows ``a, slice, b, val`` come in order: first the hub's own set(s), where b is null, then its partners'."""

    def run(batches):
        import pyarrow as pa

        at, hub = None, []
        for rows in batches:
            found: list[tuple[int, int]] = []
            for a, part, b, val in zip(rows.column("a").to_pylist(), rows.column("slice").to_pylist(), rows.column("b").to_pylist(), rows.column("val"), strict=True):
                y = np.frombuffer(val.as_buffer(), np.uint64)
                if at != (a, part):
                    at, hub = (a, part), []
                if b is None:
                    hub.append(y.copy())
                    continue
                for x in hub:
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """``id, comp`` of every document in a link: the smallest identifier that it reaches. Large-star and small-star steps, each a grouped minimum and a join whose hubs Spark splits, until nothing changes."""
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark, k = None, 0
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        # Done where every document has one edge and none of these leads on: all are stars about their smallest identifier.
        if now == mark or now[0] == now[2] and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()).groupBy("id").agg(F.min("comp").alias("comp"))
        mark, k = now, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        more = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = scratch.table(least.select("u", F.col("m").alias("v")).unionByName(more).distinct(), f"{name}-{k}")


_CELL_COLUMNS = ("bucket", "i", "j", "id", "comp", "left", "big", "n_shingles")


def _cells(least: np.ndarray, percent: int, tries: int | None):
    """Candidates of each cell, which comes in one row after another. Left rows are documents outside their bucket's largest component; each is compared with the right rows of other components. A pair counts in the first band that it shares, so it is found once."""

    def cell(rows: dict[str, np.ndarray]):
        right = np.flatnonzero(~rows["left"])
        band = int(np.flatnonzero(rows["bands"][0] == rows["bucket"][0])[0])
        out = []
        for i in np.flatnonzero(rows["left"]):
            own = right[(rows["comp"][right] != rows["comp"][i]) & (rows["id"][right] != rows["id"][i])]
            own = own[rows["big"][own] | (rows["id"][own] > rows["id"][i])]
            own = own[~(rows["bands"][own, :band] == rows["bands"][i, :band]).any(1)]
            for bins in ("coarse", "fine"):
                good, share = agree(rows[bins][i], rows[bins][own], rows["n_shingles"][i], rows["n_shingles"][own], least, percent)
                own = own[good]
            if tries is not None and len(own) > tries:
                own = own[np.lexsort((rows["id"][own], -share))[:tries]]
            x = rows["id"][i]
            out += [(min(x, y), max(x, y)) for y in rows["id"][own].tolist()]
        return out

    def run(batches):
        import pyarrow as pa

        held: list[dict[str, np.ndarray]] = []

        def flush(upto: list):
            cols = {c: np.concatenate([h[c] for h in upto]) for c in upto[0]}
            found = []
            if len(cols["id"]):
                change = np.flatnonzero((np.diff(cols["bucket"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)) + 1
                for a, b in zip([0, *change], [*change, len(cols["id"])], strict=True):
                    found += cell({c: v[a:b] for c, v in cols.items()})
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in _CELL_COLUMNS}
            cols["bands"] = _matrix(b.column("bands"), np.int64, b.num_rows)
            cols["coarse"], cols["fine"] = (_matrix(b.column(c), np.uint16, b.num_rows) for c in ("coarse", "fine"))
            last = np.flatnonzero((np.diff(cols["bucket"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0))
            same = held and all(held[-1][c][-1] == cols[c][0] for c in ("bucket", "i", "j"))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not same and held:
                yield flush(held)
                held = []
            if cut:
                held.append({c: v[:cut] for c, v in cols.items()})
                yield flush(held)
                held = []
            held.append({c: v[cut:] for c, v in cols.items()})
        if held:
            yield flush(held)

    return run


def _pick(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``id`` is in ``ids``, a stored table of distinct identifiers: few enough ones are broadcast, so the rest of ``table`` isn't shuffled."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _open_cells(members: DataFrame, comps: DataFrame, sketches: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """Rows of the buckets that still hold several components, dealt to cells of bounded size."""
    tagged = scratch.table(members.join(comps, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp")), f"{name}-tagged")
    per = tagged.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = per.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("m"), F.max_by("comp", F.struct("k", F.negative("comp"))).alias("largest"), F.max("k").alias("most")).where("comps > 1 and m > 2")
    rows = tagged.join(mixed, "bucket")
    n_right, n_left = F.ceil(F.col("m") / CELL), F.ceil((F.col("m") - F.col("most")) / CELL)
    rows = scratch.table(rows.select("bucket", "id", "comp", (F.col("comp") == F.col("largest")).alias("big"), n_right.alias("ni"), n_left.alias("nj")), f"{name}-open")
    if rows.isEmpty():
        return None
    h = F.xxhash64("id", "bucket")
    right = rows.select("*", F.lit(False).alias("left"), F.pmod(h, "ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    left = rows.where(~F.col("big")).select("*", F.lit(True).alias("left"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(h, "nj").alias("j"))
    ids = scratch.table(rows.select("id").distinct(), f"{name}-ids")
    return right.unionByName(left).drop("ni", "nj").join(_pick(sketches, ids), "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document is the set of its distinct runs
    of ``shingle`` words, its whole sequence if it has fewer, nothing if it has none. Two documents are linked if 100
    times their common shingles are at least ``percent`` times all their shingles; ``component_id`` is the smallest
    identifier reachable over links.

    Documents of one set are one class, so copies cost nothing further. Classes that agree in a whole band of their
    MinHash signature meet in a bucket. First every member is tried against its bucket's smallest identifier. Then
    only buckets with several components are open: members outside a bucket's largest component are tried against the
    members of other components, the best few first, and in a last round all. Candidates are pruned by comparing
    sketches in batches of bins, coarse ones then fine ones, until the posterior chance of a link is under ``miss``;
    survivors are checked on their full sets. A sketch is the set's one-permutation MinHash signature (a minimum per
    bin of one hash function), and a look compares one batch of its bins. Pairs inside a component are never made.
    Large buckets are cut into cells, and a hub's many partners into slices. Words and shingles are known by 64 bits
    of hash, sets by 128. A link is missed
    with a chance of about (1 - s^ROWS)^BANDS plus ``miss`` for each look, s being its similarity, and only if no other
    path joins the two.

    Null and empty texts have an empty set and stand alone. Rows with a null identifier get the component of their
    class if it has an identifier, else null, and are not kept. Rows that share an identifier are one document with
    several sets. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    least = least_matches(percent, miss)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.table(plain.mapInArrow(frugal(_sign(shingle)), SIGNED), "signed")
    some = signed.where("set_key is not null")
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "coarse", "fine")]
    classes = scratch.table(some.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), *first), "classes")
    named = classes.where("id is not null")
    bands = scratch.table(named.select("id", "bands").mapInArrow(frugal(_band), "bucket long, id long").distinct(), "bands")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("hub")).where("m > 1")
    members = scratch.table(bands.join(buckets, "bucket").select("bucket", "hub", "id"), "members")
    scratch.drop("bands")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose full sets are similar enough. A hub's partners are dealt to as many slices as the largest hub needs, and its set travels once to each that has any: never more often than it has partners."""
        ids = scratch.table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
        texts = _pick(plain.withColumnRenamed("doc_id", "id"), ids)
        sets = scratch.table(texts.mapInArrow(frugal(_texts_to_sets(shingle)), "id long, val binary"), f"{name}-sets")
        most = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        cut = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(-(-most // SLICE))).alias("slice"), "b")
        hubs = cut.select("a", "slice").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "slice", F.lit(None).cast("long").alias("b"), "val")
        partners = cut.join(sets.withColumnRenamed("id", "b"), "b").select("a", "slice", "b", "val")
        dealt = hubs.unionByName(partners).repartition(parts, "a", "slice").sortWithinPartitions("a", "slice", F.col("b").asc_nulls_first())
        out = scratch.table(dealt.mapInArrow(frugal(_exact(percent)), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-sets")
        return out

    star = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    coarse = named.select("id", "n_shingles", "coarse")
    star = star.join(coarse.toDF("a", "na", "ca"), "a").join(coarse.toDF("b", "nb", "cb"), "b")
    tried = scratch.table(star.mapInArrow(frugal(_prune(least, percent)), "a long, b long"), "star-tried")
    links = verify(tried, "star")
    comps = scratch.table(components(scratch, links, "comp-0"), "comps-0")
    for k, tries in enumerate((FIRST_TRIES, None), 1):
        rows = _open_cells(members, comps, named.select("id", "n_shingles", "bands", "coarse", "fine"), scratch, f"open-{k}")
        if rows is None:
            break
        dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        fresh = scratch.table(dealt.mapInArrow(frugal(_cells(least, percent, tries)), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), f"fresh-{k}")
        if fresh.isEmpty():
            continue
        links = links.unionByName(verify(fresh, f"more-{k}"))
        tried = tried.unionByName(fresh)
        comps = scratch.table(components(scratch, links, f"comp-{k}"), f"comps-{k}")
    known = classes.select("set_key", "id").join(comps, "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "set_key")
    found = rows.where("set_key is not null").join(known, "set_key")
    alone = rows.where("set_key is null").withColumn("component_id", F.col("doc_id"))
    out = found.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


SQL = {
    "op3_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least ON least.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
