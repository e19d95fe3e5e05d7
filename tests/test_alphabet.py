import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomseq.functions import alphabet as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_reverse_complement(spark):
    assert A.reverse_complement_text("ATTGAGATAGTGGNGG") == "CCNCCACTATCTCAAT"
    assert A.reverse_complement_text("RSH") == "DSY"
    assert one(spark, A.reverse_complement(F.lit("ATTGAGATAGTGGNGG"))) == "CCNCCACTATCTCAAT"
    assert one(spark, A.reverse_complement(F.lit("RSHu"))) == "aDSY"
    assert A.reverse_complement_text("ACZ", lossy=True) == "NGT"


def test_encode(spark):
    assert one(spark, A.encode(F.lit("acZu"))) == "ACNT"
    assert one(spark, A.encode(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="position 2"):
        one(spark, A.encode(F.lit("ACZ"), strict=True))
    with pytest.raises(ValueError, match="position 1"):
        A.check("NXG")


def test_variants():
    assert A.pam_variants("NGG") == ["AGG", "CGG", "GGG", "TGG"]
    assert A.pam_variants("RYG")[0] == "ACG" and A.pam_variants("RYG")[3] == "GTG"
    with pytest.raises(ValueError):
        A.pam_variants("N" * 9)
    with pytest.raises(ValueError):
        A.pam_index("RYG", "CCG")


@given(st.text("ACGTRYSWKMN", min_size=1, max_size=5))
def test_index_is_place_in_list(pam):
    variants = A.pam_variants(pam)
    assert variants == sorted(variants)
    for i in {0, len(variants) // 2, len(variants) - 1}:
        assert A.pam_index(pam, variants[i]) == i


def test_variants_table(spark):
    got = [(r.pam_id, r.variant) for r in A.pam_variants_table(spark, "NRG").orderBy("pam_id").collect()]
    assert got == list(enumerate(A.pam_variants("NRG")))


def test_scalars(spark):
    assert one(spark, A.mutation_score(F.lit("ANAB"))) == 9
    assert one(spark, A.n_count(F.lit("ANnB"))) == 2
    assert one(spark, A.dna_to_rna(F.lit("ACTt"))) == "ACUu" and one(spark, A.rna_to_dna(F.lit("ACUu"))) == "ACTt"
    assert one(spark, A.subsequence(F.lit("ACGTA"), 1, 3)) == "CG"
    assert one(spark, A.codes_match(F.lit("R"), F.lit("a"))) is True and one(spark, A.codes_match(F.lit("R"), F.lit("Y"))) is False
    assert one(spark, A.bare_contig(F.lit("HG1#2#chr1"))) == "chr1" and one(spark, A.bare_contig(F.lit("chr1"))) == "chr1"
    assert tuple(one(spark, A.pansn(F.lit("HG1#2#c#1")))) == ("HG1", 2, "c#1")
    for odd in ("HG1#x#c", "HG1#1", "#1#c"):
        assert one(spark, A.pansn(F.lit(odd))) is None
    assert [one(spark, A.bulge_type(F.lit(d), F.lit(r))) for d, r in ((0, 0), (1, 0), (0, 1), (1, 1))] == ["X", "DNA", "RNA", "DNA/RNA"]
    assert one(spark, A.flip_strand(F.lit("+"), F.lit(True))) == "-" and one(spark, A.flip_strand(F.lit("-"), F.lit(None).cast("boolean"))) == "-"


def test_cas_systems():
    assert A.cas_system("NGG") == "SpCas9" and A.cas_system("ngk") == "xCas9" and A.cas_system("TTTV", True) == "Cpf1"
    assert A.cas_system("TTTV") is None and A.cas_system("NGG", True) is None and A.cas_system("TTCN") == "CasX"
