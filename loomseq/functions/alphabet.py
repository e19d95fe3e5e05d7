"""Nucleotide alphabet: ambiguity codes, complements, PAM patterns and names, as Column functions and, for short literals, on strings."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The IUPAC nucleotide codes and the bases that each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
BASES = "ACGT"
MASK = {code: sum(1 << BASES.index(b) for b in bases) for code, bases in IUPAC.items()}
_CODES = "".join(c for c in IUPAC if c != "U")
_BY_MASK = {MASK[c]: c for c in _CODES}


def _complement(code: str) -> str:
    return _BY_MASK[sum(1 << (3 - BASES.index(b)) for b in IUPAC[code])]


_COMPLEMENTS = "".join(_complement(c) for c in _CODES)

# PAM motifs of each nuclease.
CAS_PAMS = {
    "CasX": ["TTCN"],
    "Cpf1": ["TTN", "TTTN", "TYCV", "TATV", "TTTV", "TTTR", "ATTN", "TTTA", "TCTA", "TCCA", "CCCA", "YTTV", "TTYN"],
    "SaCas9": ["NNGRRT", "NNNRRT"],
    "SpCas9": ["NGG", "NGA", "NRG", "NGC"],
    "xCas9": ["NGK", "NGN", "NNG"],
}
#: Nucleases by where their PAM stands: None for either side.
_SIDE = {"CasX": None, "Cpf1": True, "SaCas9": None, "SpCas9": False, "xCas9": False}
MAX_VARIANTS = 65_536


# --- columns ---


def encode(seq: Column, strict: bool = False) -> Column:
    """Upper-case IUPAC text with T for U. Anything else becomes N, or, if ``strict``, fails. Null stays null."""
    up = F.replace(F.upper(seq), F.lit("U"), F.lit("T"))
    bad = f"[^{_CODES}]"
    if strict:
        at = F.regexp_instr(up, F.lit(bad))
        return F.when(at > 0, F.raise_error(F.concat(F.lit("invalid nucleotide at position "), (at - 1).cast("string")))).otherwise(up)
    return F.regexp_replace(up, bad, "N")


def reverse_complement(seq: Column) -> Column:
    both = _CODES + _CODES.lower()
    return F.reverse(F.translate(seq, both + "Uu", _COMPLEMENTS + _COMPLEMENTS.lower() + "Aa"))


def dna_to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def n_count(seq: Column) -> Column:
    """How many N (of either case) a sequence has."""
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def mutation_score(seq: Column) -> Column:
    """Bases allowed over all positions: 1 for a plain base, up to 4 for N."""
    up = F.upper(seq)
    groups = {k: "".join(c for c, b in IUPAC.items() if len(b) == k) for k in (1, 2, 3, 4)}
    return sum((F.lit(k) * (F.length(up) - F.length(F.translate(up, cs, ""))) for k, cs in groups.items()), F.lit(0)).cast("long")


def subsequence(seq: Column, start: Column | int, end: Column | int) -> Column:
    """Bases [start, end), from 0."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(seq, start + 1, F.greatest(end - start, F.lit(0)))


def codes_match(a: Column, b: Column) -> Column:
    """Whether two codes share a base."""
    table = F.create_map(*[F.lit(x) for c, m in MASK.items() for x in (c, m)])
    return F.coalesce(F.element_at(table, F.upper(a)).bitwiseAND(F.element_at(table, F.upper(b))) != 0, F.lit(False))


def bare_contig(name: Column) -> Column:
    """``sample#haplotype#contig`` to ``contig``; other names stay."""
    return F.substring_index(name, "#", -1)


def pansn(name: Column) -> Column:
    """``sample#haplotype#contig`` as a struct (sample, hap, contig), or null where a name hasn't that form."""
    parts = F.split(name, "#", 3)
    hap = F.get(parts, 1).try_cast("int")
    fits = (F.size(parts) == 3) & (F.get(parts, 0) != "") & hap.isNotNull() & (F.get(parts, 2) != "")
    return F.when(fits, F.struct(F.get(parts, 0).alias("sample"), hap.alias("hap"), F.get(parts, 2).alias("contig")))


def flip_strand(strand: Column, flipped: Column) -> Column:
    """The other strand where ``flipped`` is true."""
    return F.when(F.coalesce(flipped, F.lit(False)), F.when(strand == "+", "-").when(strand == "-", "+").otherwise(strand)).otherwise(strand)


def bulge_type(bdna: Column, brna: Column) -> Column:
    return F.when((bdna > 0) & (brna > 0), "DNA/RNA").when(bdna > 0, "DNA").when(brna > 0, "RNA").otherwise("X")


def edit_distance(mm: Column, bdna: Column, brna: Column) -> Column:
    return mm + bdna + brna


# --- literals ---


def check(motif: str) -> str:
    """Upper-case motif, or an error that tells the position of the first character that is no code."""
    up = motif.upper()
    for i, c in enumerate(up):
        if c not in IUPAC:
            raise ValueError(f"invalid nucleotide {motif[i]!r} at position {i}")
    return up


def reverse_complement_text(motif: str, lossy: bool = False) -> str:
    up = motif.upper()
    up = "".join(c if c in IUPAC else "N" for c in up) if lossy else check(up)
    return "".join(_complement(c) for c in reversed(up))


def pam_regex(pam: str) -> str:
    """A pattern for text of IUPAC codes that share a base with the PAM at every place, N matching any code."""
    out = []
    for c in check(pam):
        fits = "".join(x for x in IUPAC if MASK[x] & MASK[c])
        out.append("." if c == "N" else f"[{fits}]")
    return "".join(out)


def pam_variants(pam: str) -> list[str]:
    """The concrete PAMs, in order; a variant's place in the list is its number."""
    up = check(pam)
    count = 1
    for c in up:
        count *= len(IUPAC[c])
    if count > MAX_VARIANTS:
        raise ValueError(f"{pam} stands for {count} PAMs; {MAX_VARIANTS} are allowed")
    return ["".join(v) for v in product(*(IUPAC[c] for c in up))]


def pam_index(pam: str, variant: str) -> int:
    """The number of a concrete PAM: its mixed-radix rank, the first place most significant."""
    up, index = check(pam), 0
    if len(variant) != len(up):
        raise ValueError(f"{variant} is not of {pam}'s length")
    for i, (c, v) in enumerate(zip(up, variant.upper(), strict=True)):
        if v not in IUPAC[c]:
            raise ValueError(f"{variant} does not match {pam} at position {i}")
        index = index * len(IUPAC[c]) + IUPAC[c].index(v)
    return index


def pam_variants_table(spark: SparkSession, pam: str) -> DataFrame:
    """``pam_id, variant`` as a table, made by exploding the bases of each place."""
    pam_variants(pam)
    out = spark.range(1).select(F.lit(0).cast("long").alias("pam_id"), F.lit("").alias("variant"))
    for c in check(pam):
        bases = IUPAC[c]
        out = out.select("*", F.posexplode(F.array(*[F.lit(b) for b in bases]))).select((F.col("pam_id") * len(bases) + F.col("pos")).alias("pam_id"), F.concat("variant", "col").alias("variant"))
    return out


def cas_system(pam: str, upstream: bool = False) -> str | None:
    """The nuclease that a PAM belongs to, given its side of the protospacer, or None."""
    return next((cas for cas, pams in CAS_PAMS.items() if pam.upper() in pams and _SIDE[cas] in (None, upstream)), None)
