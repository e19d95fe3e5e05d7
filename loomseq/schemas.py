"""The relations' schemas. Nothing is inferred on reading."""

from __future__ import annotations

CONTIGS = "contig string, seq string"
WINDOWS = "contig string, strand string, pos long, window string, pam string"
ALIGNMENTS = "guide string, protospacer string, offset int, ops string, rguide string, rseq string, mm int, bdna int, brna int"

# The report's columns, in the order that its files have them; annotation columns follow.
REPORT_TYPES = {
    "chromosome": "string",
    "start": "long",
    "strand": "string",
    "sgRNA_aligned": "string",
    "target_aligned": "string",
    "mismatches": "int",
    "dna_bulges": "int",
    "rna_bulges": "int",
    "bulge_type": "string",
    "edit_distance": "int",
    "CFD_score": "float",
    "CRISTA_score": "float",
    "Elevation_score": "float",
    "aggregate_score": "float",
}
REPORT = list(REPORT_TYPES)
SCORES = ["CFD_score", "CRISTA_score", "Elevation_score", "aggregate_score"]
MAX_ANNOTATIONS = 10
MAX_TERMS = 32
BED = "chrom string, bed_start long, bed_end long, term string"
CHAIN_BLOCKS = "chain_id long, score long, t_name string, t_start long, t_end long, q_name string, q_start long, q_end long, q_strand string, file_order long"
# The columns that liftover adds to a report, and those that a merged report has instead.
LIFTED = ["hg38_chr", "hg38_pos", "hg38_flipped", "map_status"]
MERGED = ["samples", "map_status"]


def report_schema(annotations: list[str] | tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"{c} {t}" for c, t in REPORT_TYPES.items()), *(f"`{a}` string" for a in annotations)])
