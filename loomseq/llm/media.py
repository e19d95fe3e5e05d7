"""Media columns as interleaved document sequences: ordered text and media references from HTML, payloads joined by digest."""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, documents, keyed_join
from loomseq.llm.textnp import frugal

UNIT = 64
#: Digests that a task remembers so as to store a payload once; then it forgets them, and a payload may be stored again.
REMEMBER = 200_000
PREFIX = "sha256:"
SEQUENCE = "array<struct<pos:long,kind:string,text:string,ref:string,caption:string>>"
_VOID = {"script", "style", "template", "noscript"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "td", "th", "tr", "ul", "ol", "br", "figure", "figcaption", "blockquote", "pre", "nav", "table"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
STORED = "digest string, n_bytes long, media binary"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: list[int] | None = None
        self.caption = False

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and self.caption and self.figure:
            for i in self.figure:
                self.items[i]["caption"] = text
        elif text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            self.skip += 1
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")})
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = []
            self.caption = tag == "figcaption"

    def handle_endtag(self, tag):
        if tag in _VOID:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = None
            if tag == "figcaption":
                self.caption = False

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_html(html: str | None) -> list[dict]:
    """Ordered items of a page: texts between block tags, and media references with the caption of their figure or their alt text. Null, empty or broken HTML gives what can be read of it, or nothing."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": i, **x} for i, x in enumerate(p.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, items``: each page's sequence of text and media-reference structs, one row per row of ``pages``."""

    def parse(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("pos", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse_html(x.as_py()) for x in b.column(1)], kind)], names=["page_id", "items"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(frugal(parse), f"page_id {kind}, items {SEQUENCE}")


def resolve(sequences: DataFrame, payloads: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """One row per item of each sequence, ``page_id, pos, kind, text, ref, caption, digest`` and the columns of ``payloads``, which has one row per ``digest``.

    A reference ``sha256:<digest>`` is joined by what follows the prefix. Items keep their place and caption whether or not their
    payload is known (its columns are null then). A digest that very many pages show is broadcast with its columns of
    ``payloads``, known or not, and never dealt to one task; so let these be small, such as features or a location.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "resolve")
    items = sequences.select("page_id", F.explode("items").alias("i")).select("page_id", "i.*")
    items = scratch.table(items.withColumn("digest", F.when(F.col("ref").startswith(prefix), F.col("ref").substr(len(prefix) + 1, 200))), "items")
    uses = items.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
    table = scratch.table(uses.join(payloads, "digest", "left"), "payloads")
    media = keyed_join(items.where("digest is not null"), table, ["digest"], "_n", items.count(), "left")
    return media.drop("_n").unionByName(items.where("digest is null"), allowMissingColumns=True)


def encode_media(payload: bytes) -> bytes:
    """A payload as an 8-bit grey image of ``UNIT`` samples a row: the plain netpbm header, then the bytes themselves."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def decode_media(media: bytes) -> bytes:
    head = media.split(b"\n", 3)
    if len(head) != 4 or head[0] != b"P5" or head[2] != b"255":
        raise ValueError("not an 8-bit grey image")
    width, rows = map(int, head[1].split())
    if width * rows != len(head[3]):
        raise ValueError("samples don't fill the image")
    return head[3]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zeros up to a positive multiple of ``UNIT``, and how many there were before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b"\0"), len(raw)


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, entropy of their histogram in bits, mean step between neighbours, each to three decimals."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(x)
    spread = max(0.0, float((counts * values**2).sum()) / len(x) - mean * mean) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).sum()) / (len(x) - 1)
    return f"rows={len(x) // UNIT};mean={mean:.3f};std={spread:.3f};entropy={abs(float(-(p * np.log2(p)).sum())):.3f};step={step:.3f}"


def _store(batches):
    """Each distinct payload of a partition once, as stored media."""
    import pyarrow as pa

    seen: set[bytes] = set()
    for b in batches:
        out: list[tuple] = []
        size = 0
        for x in b.column("text"):
            payload, n = payload_of(x.as_py())
            digest = hashlib.sha256(payload)
            key = digest.digest() + n.to_bytes(8, "little")
            if key in seen:
                continue
            if len(seen) >= REMEMBER:
                seen.clear()
            seen.add(key)
            out.append((f"{digest.hexdigest()}-{n}", n, encode_media(payload)))
            size += len(payload)
            if size > 16_000_000:
                yield _stored(pa, out)
                out, size = [], 0
        if out:
            yield _stored(pa, out)


def _stored(pa, rows):
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["digest", "n_bytes", "media"])


def _features(batches):
    import pyarrow as pa

    names = [x.strip().split()[0] for x in FEATURES.split(",")]
    for b in batches:
        rows = []
        for digest, media in zip(b.column("digest").to_pylist(), b.column("media"), strict=True):
            media = media.as_py()
            payload = decode_media(media)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in cols], names=names)


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each document's bytes as media, read them back and compute features; one row per row of ``docs``.

    A document becomes a page: a paragraph for each of its lines, then a figure, whose image is a reference by digest
    and length and whose caption is the identifier. The page is parsed to its sequence of texts and the reference
    (``pos`` is the reference's place in it), and the reference resolved like any other. The stored table holds a
    payload once for each partition that has it (more often where a partition has over REMEMBER payloads); it is
    written by Spark's own committed writer to the shared folder and read back from there. Only digests and features
    are shuffled, never payloads or texts. Null text is empty: one row of zeros. Null and repeated identifiers keep
    their rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(text).cast("long")
    zeros = F.when(n == 0, UNIT).otherwise((UNIT - n % UNIT) % UNIT).cast("int")
    digest = F.concat(F.sha2(F.concat(F.encode(text, "UTF-8"), F.expr("cast(repeat(decode(X'00', 'UTF-8'), %d) as binary)" % UNIT).substr(F.lit(1), zeros)), 256), F.lit("-"), n.cast("string"))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.concat(F.lit("<article><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))
    html = F.concat(paragraphs, F.lit(f'<figure><img src="{PREFIX}'), digest, F.lit('"><figcaption>'), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("</figcaption></figure>"))
    whole = interleave(docs.select(F.col(id_col).alias("page_id"), html.alias("html")))
    sequences = whole.select("page_id", F.filter("items", lambda i: i["kind"] == "media").alias("items"))  # texts have no payload to resolve
    stored = scratch.table(docs.select(text.alias("text")).mapInArrow(frugal(_store), STORED), "stored")
    features = stored.select("digest", "media").mapInArrow(frugal(_features), FEATURES)
    fields = [x.strip().split()[0] for x in FEATURES.split(",")][1:]
    one = features.groupBy("digest").agg(*[F.first(c).alias(c) for c in fields])
    return resolve(sequences, one).select(F.col("page_id").alias("doc_id"), F.substring_index("digest", "-", -1).cast("long").alias("n_bytes"), *fields, "pos", "caption")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_media(documents(spark, sf_dir))


SQL: dict[str, str] = {}
