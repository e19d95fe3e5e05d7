"""What the operators of this subpackage share: tables in the folder that the whole cluster sees, and joins that no single key can overload."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_KEYS of all rows is hot, so there are fewer than HOT_KEYS hot keys, whatever the data.
HOT_KEYS = 2000
#: Below so many rows a key is never worth a treatment of its own.
HOT_ROWS = 1000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local, as in tests, a folder made here. On a cluster it has to be set: a folder of one machine would be another one on the next."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = _own.setdefault(spark.sparkContext.applicationId, "")
        if not found:
            found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomseq-")
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one query, written to the shared folder (so that lost executors cost no lineage) and dropped when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(delete, spark, self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def hot_limit(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_KEYS)


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, n_rows: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key, whose column ``count`` bounds from below how many of ``rows`` have the key.

    Keys of over ``hot_limit(n_rows)`` rows go by broadcast: there are under HOT_KEYS of them. The others go by a
    shuffle in which no key has more rows than that limit. ``how``: inner or left. Both inputs should be stored tables:
    each is read twice.
    """
    limit = hot_limit(n_rows)
    hot = F.broadcast(table.where(F.col(count) > limit))
    cold = table.where(F.col(count) <= limit)
    first = rows.join(hot, keys, "inner")
    rest = rows.join(F.broadcast(table.where(F.col(count) > limit).select(*keys)), keys, "left_anti").join(cold, keys, how)
    return first.unionByName(rest)


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
