"""Token shards: raw ids of documents in order, with a minimal perfect hash index from a document's key to its place."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents
from loomseq.llm.textnp import frugal, slices

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
MAGIC = b"LMSHARD1"
#: Mean keys in a bucket of the hash index; each bucket keeps one 32-bit seed.
BUCKET = 4
#: Most tasks that read shards; each reads one after the other.
READERS = 10_000
MANIFEST = "shard long, path string, docs long, ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def key_hash(doc_ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64 bits of each key: identifier, whether it is null, and which of its rows in the shard."""
    with np.errstate(over="ignore"):
        return _mix(_mix(doc_ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ _mix(copies.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64) + np.uint64(1)))


def _slot(h: np.ndarray, seed, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h ^ (np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) if np.isscalar(seed) else seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def build_mph(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slots): a seed for each bucket so that all keys get different slots from 0 up to n (hash and displace). Equal hashes are refused."""
    n = len(h)
    if len(np.unique(h)) != n:
        raise ValueError("two keys of a shard have one hash")
    buckets = max(1, -(-n // BUCKET))
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    of = (_mix(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=buckets)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for b in np.argsort(-counts, kind="stable"):
        own = order[firsts[b] : firsts[b + 1]]
        if not len(own):
            break
        for start in range(0, 2**31, 256):  # many seeds at once
            tries = np.arange(start, start + 256, dtype=np.uint64)
            with np.errstate(over="ignore"):
                at = (_mix(h[own][None, :] ^ (tries * np.uint64(0x9E3779B97F4A7C15))[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(1)
            if len(own) > 1:
                good &= (np.diff(np.sort(at, 1), axis=1) != 0).all(1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b] = start + k
                slots[own] = at[k]
                taken[at[k]] = True
                break
    return seeds, slots


def find_slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return _slot(h, seeds[(_mix(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(len(seeds))).astype(np.int64)], n)


def _key_columns(doc_ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], bool)
    copies, seen = np.zeros(len(ids), np.int64), {}
    for i, d in enumerate(doc_ids):
        copies[i] = seen[d] = seen.get(d, -1) + 1
    return ids, nulls, copies


class Shard:
    """An open shard. ``get(doc_id)`` finds a document's ids with one hash, one look at its slot and one slice.

    Layout: magic, header length (8 bytes), header (JSON), then arrays one after the other: bucket seeds (u4), and by
    slot fingerprints (u4), first id (u8) and number of ids (u4); then the keys in order (doc_id i8, null u1); then the
    raw ids, u2 if the vocabulary allows, else u4.
    """

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("no shard")
        size = int.from_bytes(self.data[8:16], "little")
        self.head = json.loads(bytes(self.data[16 : 16 + size]))
        at = 16 + size
        for name, kind, count in self.head["arrays"]:
            a = np.frombuffer(self.data, kind, count, at)
            setattr(self, name, a)
            at += a.nbytes

    def find(self, doc_ids: np.ndarray, nulls: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 where the fingerprint tells that the shard has no such key."""
        n = self.head["docs"]
        h = key_hash(doc_ids, nulls, copies)
        if not n:
            return np.full(len(h), -1), np.zeros(len(h), np.int64)
        slot = find_slots(h, self.seeds, n)
        good = self.prints[slot] == (h >> np.uint64(32)).astype(np.uint32)
        return np.where(good, self.firsts[slot].astype(np.int64), -1), np.where(good, self.counts[slot].astype(np.int64), 0)

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        first, count = self.find(np.array([doc_id or 0], np.int64), np.array([doc_id is None]), np.array([copy]))
        return None if first[0] < 0 else self.ids[first[0] : first[0] + count[0]]


def shard_bytes(doc_ids: list, counts: np.ndarray, ids: list[np.ndarray], wide: bool) -> list[bytes]:
    keys, nulls, copies = _key_columns(doc_ids)
    h = key_hash(keys, nulls, copies)
    seeds, slots = build_mph(h) if len(h) else (np.zeros(1, np.uint32), np.zeros(0, np.int64))
    n = len(h)
    prints, firsts, sizes = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    prints[slots] = (h >> np.uint64(32)).astype(np.uint32)
    firsts[slots] = np.cumsum(counts) - counts
    sizes[slots] = counts
    total = int(np.sum(counts))
    kind = "<u4" if wide else "<u2"
    arrays = [("firsts", "<u8", firsts), ("keys", "<i8", keys.astype("<i8")), ("seeds", "<u4", seeds.astype("<u4")), ("prints", "<u4", prints), ("counts", "<u4", sizes), ("ids", kind, None), ("nulls", "|b1", nulls)]
    arrays = [*arrays[:5], arrays[6], arrays[5]]
    spec = [(name, kind, total if a is None else len(a)) for name, kind, a in arrays]
    head = json.dumps({"docs": n, "ids": total, "arrays": spec}).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *(a.tobytes() for _, _, a in arrays if a is not None), *(i.astype(kind).tobytes() for i in ids)]


def _writer(path: str, folder: str, end_id: int, shard_ids: int):
    def write_part(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from loomseq.llm.encoding import encoder

        enc, task = encoder(path), TaskContext.get()
        wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 2**16
        files, root = fs.FileSystem.from_uri(folder)
        doc_ids, counts, ids, held, number = [], [], [], 0, 0
        out: list[tuple] = []

        def flush():
            nonlocal doc_ids, counts, ids, held, number
            shard = (task.partitionId() << 20) + number
            # Every attempt has a file of its own; the manifest, which Spark commits once a task, lists those that count.
            final = f"{root}/{shard:016d}-{task.taskAttemptId()}.shard"
            with files.open_output_stream(final) as f:
                for part in shard_bytes(doc_ids, np.array(counts, np.int64), ids, wide):
                    f.write(part)
            out.append((shard, final, len(doc_ids), held))
            doc_ids, counts, ids, held, number = [], [], [], 0, number + 1

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                got, at = enc.encode_bytes(data, offsets)
                for j in range(len(offsets) - 1):
                    if held >= shard_ids:
                        flush()
                    x = np.append(got[at[j] : at[j + 1]], end_id).astype("<u4" if wide else "<u2")
                    doc_ids.append(own[first + j])
                    counts.append(len(x))
                    ids.append(x)
                    held += len(x)
        if doc_ids:
            flush()
        yield pa.RecordBatch.from_pydict({"shard": [o[0] for o in out], "path": [o[1] for o in out], "docs": [o[2] for o in out], "ids": [o[3] for o in out]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return write_part


def _reader(folder: str):
    def read_part(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(row["path"]) as f:
                    shard = Shard(f.read())
                keys = [None if z else int(k) for k, z in zip(shard.keys, shard.nulls, strict=True)]
                first, count = shard.find(*_key_columns(keys))
                if (first < 0).any():
                    raise ValueError(f"{row['path']}: its index misses keys")
                crc = [zlib.crc32(shard.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(first, count, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first + row["before"]), pa.array(count), pa.array(crc, pa.int64()), pa.array([row["shard"]] * len(keys), pa.int64())], names=[x.strip().split()[0] for x in RESULT.split(",")])

    return read_part


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int = END_ID, shard_ids: int = 1 << 24) -> DataFrame:
    """Encode, write and list the shards: ``shard, path, docs, ids``, in ascending order of the documents' identifiers.

    ``folder`` has to be one that all executors see and that pyarrow can open (file, hdfs, s3, gs, ...). Documents are
    dealt by ranges of (doc_id, hash of text), so that even one identifier's many rows spread; a partition writes one
    shard or, over ``shard_ids`` ids, several. Null identifiers come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("_h"))
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return ranged.mapInArrow(frugal(_writer(path, folder, end_id, shard_ids)), MANIFEST)


def store(docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Write shards, then read every document back through its shard's index: ``doc_id, start, n_tokens, ids_crc32, shard``.

    ``start`` counts the ids of all documents before it. Null texts are empty: just the end id. Null and repeated
    identifiers keep a record each; a repeated one is told apart by its number among its rows in the shard. An empty
    table gives no shards and no rows. Other columns are not read. The manifest tells which files of the folder count; a
    repeated attempt's file may lie beside them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-store")
    folder = folder or f"{scratch.path}/shards"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    shards = scratch.table(write_shards(docs, folder, **how), "manifest")
    n = shards.count()
    # One row a shard, of many million ids: a sum along them is little work for the one task that it takes.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.select("shard", "path", before.alias("before")).repartition(min(max(1, n), READERS))
    return listed.mapInArrow(frugal(_reader(folder)), RESULT)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir)).drop("shard")
