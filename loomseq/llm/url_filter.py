"""URL filters: host and path rules, and a blocked Bloom filter of listed canonical URLs before an exact hash join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, keyed_join

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The default list is made by rule: sites named by a pair of these words, and pages of sites named by one of them.
NAMES = ("ads", "bet", "bonus", "casino", "cash", "cheap", "click", "coupon", "crypto", "farm", "free", "loan", "lotto", "miracle", "money", "pills", "prize", "promo", "replica", "slots", "spam", "track", "viagra", "win")
ENDINGS = ("net", "org", "info", "biz")
PAGES = 10
BITS_PER_URL = 12
WORDS = 4  # longs in a block
PROBES = 6
#: Blocks of 40 bytes each that may be broadcast; a larger filter is joined by a shuffle on the block's number.
BROADCAST_BLOCKS = 200_000
#: Pages found in the list, by host and path, that may be broadcast; more are joined by a shuffle.
BROADCAST_HITS = 50_000
_MOBILE = r"^(?:www|m|blog)\."


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    host = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null. Of rules equally long, the longer host wins, then the first."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    out = None
    for verdict, h, p in (rules[i] for i in order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., then the path without ``index.html``, ``.html`` or a last slash; a site's own page ends in ``/``."""
    p = F.regexp_replace(F.regexp_replace(path, r"(?:/index)?\.html?$", ""), r"/+$", "")
    return F.concat(F.regexp_replace(host, _MOBILE, ""), F.when(p == "", F.lit("/")).otherwise(p))


def expressions(host: Column, path: Column) -> Column:
    """What a listed URL may look like to cover this one: its own canonical URL, and the page ``/`` of its host and of each parent domain."""
    bare = F.regexp_replace(host, _MOBILE, "")
    labels = F.split(bare, r"\.", -1)
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, k, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(host, path)), sites))


def listed_urls(spark: SparkSession) -> DataFrame:
    """The default list as a table ``url``: 2304 sites and 3840 pages, all canonical."""

    def all_of(*columns: tuple[tuple[str, ...] | list[int], str]) -> DataFrame:
        out = spark.range(1).drop("id")
        for values, name in columns:
            out = out.select("*", F.explode(F.array(*[F.lit(str(v)) for v in values])).alias(name))
        return out

    sites = all_of((NAMES, "a"), (NAMES, "b"), (ENDINGS, "e")).select(F.concat("a", F.lit("-"), "b", F.lit(".example."), "e", F.lit("/")).alias("url"))
    pages = all_of((NAMES, "a"), (ENDINGS, "e"), (("en", "de", "fr", "es"), "l"), (list(range(PAGES)), "n")).select(F.concat("a", F.lit(".example."), "e", F.lit("/"), "l", F.lit("/offer-"), "n").alias("url"))
    return sites.unionByName(pages)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of URLs, one a line, as canonical URLs ``url``; blank lines and lines that begin with # are skipped, a line without ``://`` is host and path."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.when(line.contains("://"), line).otherwise(F.concat(F.lit("http://"), line)).alias("u"))
    return rows.select(canonical(url_host(F.col("u")), url_path(F.col("u"))).alias("url")).distinct()


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """One long per word of a block with this URL's bits set."""
    h = F.xxhash64(F.lit(11), url)
    words = [F.lit(0).cast("long")] * WORDS
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, i * 8).bitwiseAND(F.lit(255))
        one = F.expr("1L")
        words = [w.bitwiseOR(F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", one, (bit % 64).cast("int"))).otherwise(F.lit(0).cast("long"))) for k, w in enumerate(words)]
    return words


def bloom(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """``block, w0 .. w3``: the filter as one row per block that has a bit set."""
    masks = [m.alias(f"m{k}") for k, m in enumerate(_masks(F.col(url_col)))]
    return listed.select(_block(F.col(url_col), blocks).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, listed_url``.

    Rules decide first. A page that no rule fits is blocked if ``listed`` (one column: canonical URLs) has its
    canonical URL or the ``/`` of its host or a parent domain, else it gets ``default``. Each candidate's block of the
    Bloom filter is looked up, only candidates with all bits set go on to an exact join with the list, and that join
    removes false positives. The filter is broadcast if its number of blocks, which is known, allows; else it is
    joined by block, with repeated candidates merged first so that no host is hot. What the list has is counted, with
    the pages that it stands for: heavy sites and URLs are joined by a broadcast, the others by a shuffle. Pages that
    a rule decides, and those without a host, are not joined at all. Null or strange URLs have an empty host and path
    and fit no rule or list. Null or repeated identifiers, an empty table or an empty list are fine.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    url_list = listed.select(F.col(listed.columns[0]).alias("cand")).where("cand is not null").distinct()
    blocks = max(1, -(-url_list.count() * BITS_PER_URL // (64 * WORDS)))
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    is_open = F.col("_r").isNull() & (F.col("host") != "")
    open_urls = rows.where(is_open).groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    cand = open_urls.select("host", "path", "m", F.explode(expressions(F.col("host"), F.col("path"))).alias("cand"))
    possible = scratch.table(possible_hits(cand, url_list, blocks), "possible")
    found = scratch.table(possible.groupBy("cand").agg(F.count(F.lit(1)).alias("n")).join(url_list, "cand"), "found")
    exact = keyed_join(possible, found, ["cand"], "n", possible.count()).groupBy("host", "path").agg(F.max_by("cand", F.struct(F.length("cand"), "cand")).alias("listed_url"), F.first("m").alias("m"))
    exact = scratch.table(exact, "exact")
    if exact.count() <= BROADCAST_HITS:
        by_site = rows.join(F.broadcast(exact.drop("m")), ["host", "path"], "left")
    else:
        joined = keyed_join(rows.where(is_open), exact, ["host", "path"], "m", rows.count(), "left").drop("m")
        by_site = joined.unionByName(rows.where(~is_open).withColumn("listed_url", F.lit(None).cast("string")))
    verdict = F.when(F.col("_r").isNotNull(), F.col("_r.verdict")).when(F.col("listed_url").isNotNull(), F.lit("block")).otherwise(F.lit(default))
    return by_site.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "listed_url")


def possible_hits(cand: DataFrame, url_list: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``cand`` whose ``cand`` passes the Bloom filter of ``url_list``, which has ``blocks`` blocks: all listed ones, and some false positives."""
    hit = None
    for k, m in enumerate(_masks(F.col("cand"))):
        test = m.bitwiseAND(F.col(f"w{k}")) == m
        hit = test if hit is None else hit & test
    filt = bloom(url_list, "cand", blocks)
    if blocks <= BROADCAST_BLOCKS:
        return cand.withColumn("block", _block(F.col("cand"), blocks)).join(F.broadcast(filt), "block").where(hit).select(*cand.columns)
    scratch = Scratch(cand.sparkSession, "url-candidates")
    cand = scratch.table(cand, "cand")
    each = cand.groupBy("cand").agg(F.count(F.lit(1)).alias("_n")).withColumn("block", _block(F.col("cand"), blocks))
    passed = scratch.table(each.join(filt.hint("shuffle_hash"), "block").where(hit).select("cand", "_n"), "passed")
    return keyed_join(cand, passed, ["cand"], "_n", cand.count()).select(*cand.columns)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(spark))


def _values(words: tuple[str, ...]) -> str:
    return ", ".join(f"('{w}')" for w in words)


SQL = {
    "op1_url_filter": rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, h, pre) AS (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in RULES)}),
r AS (SELECT p.*, (SELECT {{'v': verdict, 'r': h || pre}} FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)
                   ORDER BY length(h || pre) DESC, length(h) DESC LIMIT 1) AS hit,
           regexp_replace(p.host, '^(www|m|blog)\.', '') AS bare,
           regexp_replace(regexp_replace(p.path, '(/index)?\.html?$', ''), '/+$', '') AS pp FROM p),
names(w) AS (VALUES {_values(NAMES)}), endings(e) AS (VALUES {_values(ENDINGS)}), langs(l) AS (VALUES {_values(("en", "de", "fr", "es"))}),
listed(u) AS (SELECT a.w || '-' || b.w || '.example.' || e || '/' FROM names a, names b, endings UNION ALL SELECT w || '.example.' || e || '/' || l || '/offer-' || n FROM names, endings, langs, range({PAGES}) x(n)),
m AS (SELECT r.*, CASE WHEN hit IS NULL AND host <> '' THEN (SELECT u FROM listed WHERE u = bare || CASE WHEN pp = '' THEN '/' ELSE pp END OR u = bare || '/'
             OR ends_with(bare, '.' || regexp_replace(u, '/$', '')) AND ends_with(u, '/') ORDER BY length(u) DESC, u DESC LIMIT 1) END AS listed_url FROM r)
SELECT page_id, host, path, hit.r AS rule, CASE WHEN hit IS NOT NULL THEN hit.v WHEN listed_url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed_url FROM m
"""
}
