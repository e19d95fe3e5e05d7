"""FASTA files, guides and contigs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.functions.alphabet import check, encode, n_count, pansn, subsequence

REFERENCE_GLOB = "*.{fa,fasta}"
ASSEMBLY_GLOB = "*.{fa,fasta,fna,fa.gz,fasta.gz,fna.gz,fa.bgz,fasta.bgz,fna.bgz}"
CHUNK = 32_768


def read_fasta(spark: SparkSession, path: str | list[str], glob: str | None = None, strict: bool = False) -> DataFrame:
    """``contig, seq, file``: one row per record; a contig's name is the header's first word.

    Records are read by a splittable text scan whose separator is a line that begins with ``>``, so a file of many
    contigs is shared by many tasks. White space in sequences goes; letters that are no IUPAC code become N, or fail
    if ``strict``. Files ending in .gz are read by Spark's codec. Those ending in .bgz, block-compressed, are unpacked
    as a stream by a task each, one record in memory at a time; pyarrow has to know their file system.
    """
    reader, listing = spark.read.option("lineSep", "\n>"), spark.read.format("binaryFile")
    if glob:
        reader, listing = (x.option("pathGlobFilter", glob) for x in (reader, listing))
    name_of_file = F.col("_metadata.file_path").alias("file")
    raw = reader.text(path).select("value", name_of_file)
    packed = [f for f in raw.inputFiles() if f.endswith(".bgz")]
    if packed:
        files = listing.load(path).select(name_of_file).where(F.col("file").endswith(".bgz")).repartition(len(packed), "file")
        raw = raw.where(~F.col("file").endswith(".bgz")).unionByName(files.mapInArrow(_unpack, "value string, file string"))
    text = F.regexp_replace("value", r"^\s*>", "")
    cut = F.instr(text, "\n")
    header = F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text)
    seq = F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise(F.lit(""))
    name = F.regexp_extract(header, r"^\s*(\S*)", 1)
    return raw.where(F.trim(F.regexp_replace("value", r"[\s>]", "")) != "").select(name.alias("contig"), encode(F.regexp_replace(seq, r"\s+", ""), strict).alias("seq"), "file")


def _unpack(batches):
    """The records of block-compressed files, whose blocks are members of a gzip file, as the text scan gives them."""
    import gzip

    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        for name in b.column("file").to_pylist():
            files, at = fs.FileSystem.from_uri(name)
            with files.open_input_stream(at, compression=None) as packed, gzip.open(packed, "rt", encoding="utf-8", newline="\n") as text:
                lines: list[str] = []
                for line in text:
                    if line.startswith(">") and lines:
                        yield pa.RecordBatch.from_arrays([pa.array(["".join(lines)]), pa.array([name])], names=["value", "file"])
                        lines = []
                    lines.append(line)
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(["".join(lines)]), pa.array([name])], names=["value", "file"])


def check_contigs(contigs: DataFrame) -> DataFrame:
    """The same table, after a look for contig names that occur twice, are empty, or hold a tab or a line break: those are an error."""
    bad = contigs.groupBy("contig").count().where((F.col("count") > 1) | F.coalesce(F.col("contig") == "", F.lit(True)) | F.col("contig").rlike(r"[\t\r\n]")).limit(5).collect()
    if bad:
        raise ValueError(f"contig names that are repeated or not allowed: {[r['contig'] for r in bad]}")
    return contigs


def check_haplotypes(contigs: DataFrame) -> DataFrame:
    """The same table, after a look for files whose PanSN names tell of several samples or haplotypes, or of none."""
    names = contigs.select("file", pansn(F.col("contig")).alias("p"))
    bad = names.groupBy("file").agg(F.countDistinct(F.struct("p.sample", "p.hap")).alias("n"), F.count_if(F.col("p").isNull()).alias("odd")).where("n > 1 or odd > 0").limit(5).collect()
    if bad:
        raise ValueError(f"files that aren't of one haplotype: {[r['file'] for r in bad]}")
    return contigs


def contig_ids(contigs: DataFrame) -> DataFrame:
    """``contig_id, contig``: numbers in order of name. A dimension of one row per contig."""
    return contigs.select("contig").distinct().select((F.row_number().over(Window.orderBy("contig")) - 1).alias("contig_id"), "contig")


def contig_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``contig`` by ``contig_id``; an unknown number is shown as itself."""
    return rows.join(labels.select("contig_id", F.col("contig").alias("_label")), "contig_id", "left").withColumn("contig", F.coalesce("_label", F.col("contig_id").cast("string"))).drop("_label")


def fetch(contigs: DataFrame, contig: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A contig's bases [start, end), or all of them."""
    seq: Column = F.col("seq")
    if start is not None or end is not None:
        seq = subsequence(seq, start or 0, F.lit(end) if end is not None else F.length("seq"))
    return contigs.where(F.col("contig") == contig).select("contig", seq.alias("seq"))


def statistics(contigs: DataFrame) -> DataFrame:
    """``contig, length, n_count`` of each contig."""
    return contigs.select("contig", F.length("seq").cast("long").alias("length"), n_count(F.col("seq")).cast("long").alias("n_count"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt anew where they come from fewer files than there are cores, as one file may be one task's; with more files nothing is moved."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, *keys) if len(rows.inputFiles()) < cores else rows


def chunks(contigs: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """``contig, start, core, seq``: cores of ``size`` bases that tile each contig, each with up to ``overlap`` more bases on its right.

    Bases are cut as bytes: cutting characters out of a long string would count from its start each time.
    """
    n = F.ceil(F.length("seq") / size).cast("long")
    spread = contigs.where(F.length("seq") > 0).select("contig", F.col("seq").cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_k"))
    begin = (F.col("_k") * size).cast("int")
    return spread.select("contig", begin.cast("long").alias("start"), F.lit(size).alias("core"), F.substring(F.col("_b"), begin + 1, F.lit(size + overlap)).alias("seq"))


def read_guides(spark: SparkSession, path: str) -> list[str]:
    """Distinct guides of a FASTA file, in order of their text."""
    rows = read_fasta(spark, path, strict=True).select("seq").distinct().orderBy("seq").collect()
    return guides([r["seq"] for r in rows])


MAX_GUIDES = 100_000


def guides(sequences: list[str]) -> list[str]:
    """Guides in upper case, each once, after a check: plain bases only, of one length, at least one and at most MAX_GUIDES."""
    out = list(dict.fromkeys(check(s).replace("U", "T") for s in sequences))
    if not out or len(out) > MAX_GUIDES:
        raise ValueError(f"from 1 to {MAX_GUIDES} guides are needed")
    if len({len(g) for g in out}) > 1:
        raise ValueError("guides differ in length")
    for g in out:
        if not g or set(g) - set("ACGT"):
            raise ValueError(f"guide {g!r} has characters other than A, C, G and T")
    return out


def guides_table(spark: SparkSession, sequences: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(guides(sequences))), "guide_id int, guide string")


def pseudo_contigs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``contig, seq`` made of any text: ASCII letters become bases in turn (a and e: A, b and f: C, ...), all else goes. For trials on tables without genomes."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = "".join("ACGT"[i % 4] for i in range(len(letters)))
    rows = spread(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("contig"), F.col(text_col).alias("seq")), "contig")
    return rows.select("contig", F.translate(F.regexp_replace("seq", "[^a-zA-Z]+", ""), letters, bases).alias("seq"))
