"""Cutting frequency determination (CFD) of aligned guide and target, as one Column expression.

A score is the weight of the PAM's last two bases times, over the first 20 aligned columns, the weight of each
mismatch at its column. Gap columns and ambiguity codes weigh 1 but count as columns. The mismatch weights are a
published table of 12 kinds of mismatch by 20 places; it is a parameter, read by ``read_weights`` from the file that
the user has. Without it only targets without a mismatch have a score, that of their PAM; others are null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 20
# Published weights of a PAM's last two bases.
PAM_WEIGHTS = {
    "AA": 0.0, "AC": 0.0, "AG": 0.259259259, "AT": 0.0,
    "CA": 0.0, "CC": 0.0, "CG": 0.107142857, "CT": 0.0,
    "GA": 0.069444444, "GC": 0.022222222, "GG": 1.0, "GT": 0.016129032,
    "TA": 0.0, "TC": 0.0, "TG": 0.038961039, "TT": 0.0,
}
_COMPLEMENT = dict(zip("ACGT", "TGCA", strict=True))
#: A key of the table: the guide's base as RNA, the complement of the target's base as DNA, the column from 1.
_KEY = re.compile(r"r([ACGU]):d([ACGT]),(\d+)")

#: (guide base, target base, column from 0) -> weight
Weights = dict[tuple[str, str, int], float]


def weights_by_rule() -> Weights:
    """A made-up table of the same shape for trials of the arithmetic, never used unless it is passed: mismatches near the PAM weigh less, transitions more than transversions."""
    purine = "AG"
    return {(g, t, i): round((0.9 if (g in purine) == (t in purine) else 0.7) * (1 - i / 25), 6) for g in "ACGT" for t in "ACGT" if g != t for i in range(COLUMNS)}


WEIGHTS_BY_RULE = weights_by_rule()


def parse_weights(text: str) -> Weights:
    """Every ``rX:dY,column`` key of a text with the number that follows it: delimited files and plain-text serialisations alike. Nothing is executed."""
    out: Weights = {}
    keys = list(_KEY.finditer(text))
    for k, m in enumerate(keys):
        rest = text[m.end() : keys[k + 1].start() if k + 1 < len(keys) else len(text)]
        number = re.search(r"F([-+.\deE]+)", rest) or re.search(r"(?<![\w.])(\d+\.\d+(?:[eE][-+]?\d+)?|\d+)(?![\w.])", rest)
        if not number:
            raise ValueError(f"no weight after {m[0]}")
        out[m[1].replace("U", "T"), _COMPLEMENT[m[2]], int(m[3]) - 1] = float(number[1])
    if not out:
        raise ValueError("no mismatch weights found")
    return out


def read_weights(spark: SparkSession, path: str) -> Weights:
    """``parse_weights`` of a small file in any store that Spark reads."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: one file of weights is expected")
    return parse_weights(rows[0][0])


def cfd(rguide: Column, rseq: Column, pam: Column, weights: Weights | None, pam_weights: dict[str, float] = PAM_WEIGHTS) -> Column:
    """CFD as a float, without weights null wherever it would need one; PAMs without a weight score 0, missing mismatch weights count 1. Case does not matter, U is T.

    For each column there is one lookup in a constant map whose key is the pair of bases, so the whole score is one
    codegen-friendly product without a shuffle, a join or Python.
    """
    g, t = (F.translate(F.upper(x), "U", "T") for x in (rguide, rseq))
    last_two = F.translate(F.upper(F.right(pam, F.lit(2))), "U", "T")
    score = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in pam_weights.items() for x in (k, float(w))]), last_two), F.lit(0.0))
    if not weights:
        needed = F.lit(False)
        for i in range(COLUMNS):
            a, b = F.substring(g, i + 1, 1), F.substring(t, i + 1, 1)
            needed = needed | ((a != b) & a.isin(*"ACGT") & b.isin(*"ACGT"))
        return F.when(~needed, score).cast("float")
    for i in range(COLUMNS):
        own = {a + b: w for (a, b, k), w in weights.items() if k == i and a != b}
        if own:
            table = F.create_map(*[F.lit(x) for k, w in sorted(own.items()) for x in (k, float(w))])
            a, b = F.substring(g, i + 1, 1), F.substring(t, i + 1, 1)
            score = score * F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.element_at(table, F.concat(a, b)), F.lit(1.0)))
    return score.cast("float")


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    return spark.createDataFrame([(g, t, i, w) for (g, t, i), w in sorted(weights.items())], "guide_base string, target_base string, place int, weight double")
