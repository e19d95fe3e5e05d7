"""Licence scan by a positional index of rare tokens, in DataFrame functions only."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseq.llm.common import Scratch, ascii_lower, documents

#: Phrases whose every place counts, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Licence notices as data; a user's own file has the same form.
TEMPLATE_FILE = os.path.join(os.path.dirname(__file__), "license_templates.tsv")
#: Words too common in any text to be in the index; what's left is ranked by the corpus's own counts.
STOP = frozenset("a an and any are by for form forms free from in is of on or person public released terms that the this to under use v version with without 0 2 3 4".split())
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's rare words that have to stand at their places.
MATCH = 0.7


def read_templates(path: str = TEMPLATE_FILE) -> list[tuple[str, str, list[str]]]:
    """(label, notice, mandatory phrases) of each line of a tab-separated file; blank lines and lines that begin with # are skipped."""
    out = []
    with open(path, encoding="utf-8") as f:
        for number, row in enumerate(f, 1):
            if row.strip() and not row.startswith("#"):
                parts = row.rstrip("\n").split("\t")
                if len(parts) != 3 or not all(p.strip() for p in parts):
                    raise ValueError(f"{path}, line {number}: a label, a notice and phrases are expected")
                out.append((parts[0], parts[1], [p for p in parts[2].split("|") if p.strip()]))
    return out


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


TEMPLATES = read_templates()


def postings(templates: list[tuple[str, str, list[str]]]) -> list[tuple[str, str, int]]:
    """(word, label, place in the template) of each rare word."""
    return [(w, label, q) for label, text, _ in templates for q, w in enumerate(_words(text)) if w not in STOP]


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")

    def start(w: Column, i: Column) -> Column:
        fits = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(fits, i.cast("long"))

    return F.filter(F.transform(words, start), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: list[tuple[str, str]] = BASE, match: float = MATCH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Words are runs of digits, letters and characters from U+0080 on, A-Z lower-cased. ``n_base`` counts the places of
    all ``base`` phrases. A template is reported if ``match`` of its indexed words stand at their places from one place
    of the file on, and its mandatory phrases stand in the file. The index finds the candidates: as a template may
    lack some words at most, one of any more of its words has to fit, so its rarest words over the corpus, one more
    than it may lack, give all places where it can begin; there the postings of all its words are intersected with the
    file's by relative position. Phrases are looked for in candidates alone. ``score`` is the best share of a reported
    template; at least 0.5 where a base phrase stands, else 0. Null text is empty: no words, labels empty. Null
    identifiers are scanned like others, rows that repeat one give the same rows, an empty table gives an empty
    result. Very long texts are scanned whole. The text is read once; of files with an indexed word it is stored for
    the phrases, else what goes on is a few places per file.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "license-scan")
    index = postings(templates)
    vocab = sorted({w for w, _, _ in index})
    norm = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), _SPLIT, " "))
    t = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_t"), F.monotonically_increasing_id().alias("_row"))
    s = F.concat(F.lit(" "), F.col("_t"), F.lit(" "))
    words = F.split(F.col("_t"), " ", -1)
    has = [s.contains(f" {p} ") for p, _ in base]
    some = has[0]
    for h in has[1:]:
        some = some | h
    empty = F.array().cast("array<bigint>")
    spots = F.when(some, F.flatten(F.array(*[F.when(h, _places(words, p)).otherwise(empty) for h, (p, _) in zip(has, base, strict=True)]))).otherwise(empty)
    labels = F.filter(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, base, strict=True)]), lambda x: x.isNotNull())
    known = F.array(*[F.lit(w) for w in vocab])
    hits = F.when(
        F.arrays_overlap(words, known),
        F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("p"))), lambda x: x["w"].isin(vocab)),
    ).otherwise(F.array().cast("array<struct<w:string,p:bigint>>"))
    n_words = F.when(F.col("_t") == "", 0).otherwise(F.length("_t") - F.length(F.translate("_t", " ", "")) + 1).cast("long")
    scanned = t.select("doc_id", "_row", "_t", n_words.alias("n_words"), spots.alias("spots"), labels.alias("base"), hits.alias("hits"))
    found = scratch.table(scanned.withColumn("_t", F.when(F.size("hits") > 0, F.col("_t"))), "found")
    # Corpus counts of the index's words; there are as many as the templates have.
    df = found.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    total = found.count()
    idf = F.broadcast(df.select("w", F.log((F.lit(total) + 1) / F.col("df")).alias("idf")))
    posts = F.broadcast(spark.createDataFrame(index, "w string, label string, q long"))
    sizes = {label: len({(w, q) for w, x, q in index if x == label}) for label, _, _ in templates}
    lack = {label: sum(n / need < match for n in range(1, need + 1)) for label, need in sizes.items()}
    need = F.broadcast(spark.createDataFrame([(label, n, n - lack[label]) for label, n in sizes.items()], "label string, need long, seeds long"))
    spread = found.where("size(hits) > 0").select("_row", F.explode("hits").alias("h")).select("_row", "h.w", "h.p")
    ranked = posts.join(idf, "w", "left").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc_nulls_first("idf"), "w", "q")))
    seeds = F.broadcast(ranked.join(need, "label").where(F.col("k") <= F.col("seeds")).select("w", "label", "q"))
    starts = spread.join(seeds, "w").select("_row", "label", (F.col("p") - F.col("q")).alias("at")).distinct()
    wanted = starts.join(posts, "label").select("_row", "label", "at", "w", "q", (F.col("at") + F.col("q")).alias("p"))
    votes = wanted.join(spread, ["_row", "w", "p"]).groupBy("_row", "label", "at").agg(F.countDistinct("q").alias("n"))
    best = votes.join(need, "label").groupBy("_row", "label").agg(F.max(F.col("n") / F.col("need")).alias("share")).where(F.col("share") >= match)
    candidates = scratch.table(best.groupBy("_row").agg(F.collect_list(F.struct("label", "share")).alias("cand")), "candidates")
    wanted_phrases = {label: [" ".join(_words(p)) for p in phrases] for label, _, phrases in templates}
    stand = F.lit(False)
    for label, phrases in wanted_phrases.items():
        all_there = F.lit(True)
        for p in phrases:
            all_there = all_there & s.contains(f" {p} ")
        stand = F.when(F.col("_c.label") == label, all_there).otherwise(stand)
    checked = candidates.join(found.where("_t is not null").select("_row", "_t"), "_row").select("_row", F.explode("cand").alias("_c"), "_t").where(stand)
    verified = checked.groupBy("_row").agg(F.collect_set("_c.label").alias("more"), F.max("_c.share").alias("share"))
    out = found.drop("_t", "hits").join(verified, "_row", "left")
    more = F.coalesce(F.col("more"), F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("spots").cast("long").alias("n_base"),
        F.array_min("spots").alias("first_word"),
        F.array_max("spots").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", more))), ",").alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("spots") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _sql(templates: list[tuple[str, str, list[str]]], base: list[tuple[str, str]], match: float) -> str:
    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)

    index = postings(templates)
    need = [(label, len({(w, q) for w, x, q in index if x == label})) for label, _, _ in templates]
    phrases = [(label, f" {' '.join(_words(p))} ") for label, _, own in templates for p in own]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
base(phrase, label) AS (VALUES {values(base)}),
post(w, label, q) AS (VALUES {values(index)}),
need(label, need) AS (VALUES {values(need)}),
phrases(label, phrase) AS (VALUES {values(phrases)}),
t AS (SELECT r, ' ' || array_to_string(words, ' ') || ' ' AS t FROM d),
w AS (SELECT r, unnest(words) AS w, unnest(range(0, len(words)))::BIGINT AS p FROM d),
b AS (SELECT w.r, w.p, base.label FROM w JOIN base ON w.w = string_split(base.phrase, ' ')[1] JOIN d ON d.r = w.r
      AND array_to_string(list_slice(d.words, w.p + 1, w.p + len(string_split(base.phrase, ' '))), ' ') = base.phrase),
bb AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
v AS (SELECT w.r, post.label, w.p - post.q AS at, count(DISTINCT post.q) AS n FROM w JOIN post ON post.w = w.w GROUP BY ALL),
m AS (SELECT v.r, v.label, max(n::DOUBLE / need::DOUBLE) AS share FROM v JOIN need USING (label) GROUP BY ALL),
k AS (SELECT m.* FROM m JOIN t ON t.r = m.r WHERE share >= {match}::DOUBLE AND NOT EXISTS (SELECT 1 FROM phrases p WHERE p.label = m.label AND NOT contains(t.t, p.phrase))),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM k) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM k GROUP BY r)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN bb ON bb.r = d.r LEFT JOIN a ON a.r = d.r LEFT JOIN s ON s.r = d.r
"""


SQL = {"op9_license_scan": _sql(TEMPLATES, BASE, MATCH)}
