"""Packed forms of occurrences and edit scripts, for exchange with tools that keep them in 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of an occurrence from the lowest (strand, position, PAM number, contig number), and of a script's operations.
POS_SHIFT, PAM_SHIFT, CONTIG_SHIFT = 1, 33, 49
OPS = "=XDI"
MAX_OPS = 31


def _bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def pack_occurrence(contig_id: Column, pam_id: Column, pos: Column, strand: Column) -> Column:
    """contig (15 bits), PAM number (16), position (32) and strand (1 for +) as one long."""
    parts = [F.shiftleft(contig_id.cast("long"), CONTIG_SHIFT), F.shiftleft(pam_id.cast("long"), PAM_SHIFT), F.shiftleft(pos.cast("long"), POS_SHIFT), F.when(strand == "+", 1).otherwise(0).cast("long")]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def unpack_occurrence(packed: Column) -> Column:
    """A struct (contig_id, pam_id, pos, strand)."""
    return F.struct(
        _bits(packed, CONTIG_SHIFT, 15).cast("int").alias("contig_id"),
        _bits(packed, PAM_SHIFT, 16).cast("int").alias("pam_id"),
        _bits(packed, POS_SHIFT, 32).alias("pos"),
        F.when(packed.bitwiseAND(F.lit(1)) == 1, "+").otherwise("-").alias("strand"),
    )


def pack_ops(ops: Column) -> Column:
    """A script of up to 31 operations, two bits each, the first one highest, after a leading 1. Longer scripts are null."""
    codes = F.transform(F.split(ops, ""), lambda c: (F.instr(F.lit(OPS), c) - 1).cast("long"))
    packed = F.aggregate(codes, F.lit(1).cast("long"), lambda acc, c: F.shiftleft(acc, 2).bitwiseOR(c))
    return F.when(ops == "", F.lit(1).cast("long")).when(F.length(ops) <= MAX_OPS, packed)


def unpack_ops(packed: Column) -> Column:
    places = F.filter(F.transform(F.sequence(F.lit(MAX_OPS - 1), F.lit(0), F.lit(-1)), lambda i: F.struct(i.alias("i"), F.call_function("shiftrightunsigned", packed, i * 2).alias("v"))), lambda x: x["v"] > 1)
    return F.when(packed.isNotNull(), F.array_join(F.transform(places, lambda x: F.substring(F.lit(OPS), (x["v"].bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))), ""))


def picture(rguide: Column, ops: Column, rseq: Column) -> Column:
    """An alignment in three lines: guide, bars where the bases match, target."""
    return F.concat_ws("\n", rguide, F.translate(ops, "=XDI", "|   "), rseq)
