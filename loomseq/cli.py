"""Command line: ``python -m loomseq search`` and ``search-assembly``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from loomseq.functions.alphabet import check
from loomseq.functions.cfd import read_weights
from loomseq.operators.align import Thresholds
from loomseq.operators.cluster import parse_criteria
from loomseq.schemas import MAX_ANNOTATIONS
from loomseq.search import report_prefix, search_assemblies, search_reference_many, write_partitions
from loomseq.sources.fasta import guides, read_guides

log = logging.getLogger("loomseq")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomseq", description="Off-target search on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("search", "search a reference genome"), ("search-assembly", "search the haplotypes of assemblies")):
        p = sub.add_parser(name, help=text, aliases=["search-assemblies"] if name != "search" else [])
        one = p.add_mutually_exclusive_group(required=True)
        one.add_argument("--guide", help="guide of A, C, G and T")
        one.add_argument("--sequence", help="FASTA file of guides")
        p.add_argument("--pam", required=True, help="IUPAC motif")
        p.add_argument("--mm", type=int, required=True, help="mismatches allowed")
        p.add_argument("--bdna", type=int, default=0, help="DNA bulges allowed")
        p.add_argument("--brna", type=int, default=0, help="RNA bulges allowed")
        p.add_argument("--max-edit-distance", type=int, default=0, help="edits allowed in all; 0: the sum of the three")
        p.add_argument("--upstream", action="store_true", help="the PAM stands before the protospacer")
        p.add_argument("--cluster-distance", type=int, default=3)
        p.add_argument("--prioritization-criteria", nargs="+", help="edit-dist bdna brna mm cfd crista elevation, in order")
        p.add_argument("--cfd-weights", help="file of mismatch weights by rX:dY,place")
        p.add_argument("--output", default=".", help="folder for the reports")
        p.add_argument("--output-prefix")
        p.add_argument("--log-dir", help="folder for three logs: run.log, verbose.log and error.log")
        p.add_argument("--threads", type=int, default=0, help="local cores; 0: all. Ignored where a master is set")
        if name == "search":
            p.add_argument("--fasta", required=True, help="folder of .fa and .fasta files")
            p.add_argument("--annotation", nargs="+", default=[], help="BED files")
            p.add_argument("--annotation-colnames", nargs="+")
        else:
            p.add_argument("--assemblies", required=True, help="folder of FASTA files, one per haplotype")
            p.add_argument("--chains", required=True, help="folder of chain files")
            p.add_argument("--ambiguity-tolerance", type=int, default=10)
    return top


def checked(args: argparse.Namespace) -> Thresholds:
    """Caps, after all arguments were looked at."""
    check(args.pam)
    caps = Thresholds(args.mm, args.bdna, args.brna, args.max_edit_distance)
    if args.max_edit_distance > args.mm + args.bdna + args.brna:
        raise ValueError("--max-edit-distance is over the sum of --mm, --bdna and --brna")
    if args.cluster_distance <= 0:
        raise ValueError("--cluster-distance has to be above 0")
    if "cfd" in parse_criteria(args.prioritization_criteria) and not args.cfd_weights:
        raise ValueError("ranking by cfd needs --cfd-weights")
    if args.guide:
        guides([args.guide])
    if args.command == "search":
        names = args.annotation_colnames
        if len(args.annotation) > MAX_ANNOTATIONS or names and (len(names) != len(args.annotation) or len(set(names)) != len(names)):
            raise ValueError(f"at most {MAX_ANNOTATIONS} annotations, each with a name of its own")
    elif args.ambiguity_tolerance < 0:
        raise ValueError("--ambiguity-tolerance can't be negative")
    return caps


def log_files(folder: str) -> list[logging.Handler]:
    """Handlers of three files: what a run tells, that with details, and errors."""
    os.makedirs(folder, exist_ok=True)
    made = []
    for name, fits in (("run", lambda r: r.levelno == logging.INFO), ("verbose", lambda r: r.levelno <= logging.INFO), ("error", lambda r: r.levelno >= logging.ERROR)):
        handler = logging.FileHandler(os.path.join(folder, f"{name}.log"), encoding="utf-8")
        handler.addFilter(fits)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        made.append(handler)
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s", stream=sys.stderr)
    handlers = log_files(args.log_dir) if args.log_dir else []
    level = log.level
    if handlers:
        log.setLevel(logging.DEBUG)
    for h in handlers:
        log.addHandler(h)
    try:
        return run(args, spark)
    finally:
        log.setLevel(level)
        for h in handlers:
            log.removeHandler(h)
            h.close()


def run(args: argparse.Namespace, spark: SparkSession | None) -> int:
    began = time.time()
    log.debug("%s", vars(args))
    try:
        caps = checked(args)
    except ValueError as e:
        log.error("%s", e)
        return 64
    if spark is None:
        builder = SparkSession.builder.appName("loomseq").config("spark.sql.adaptive.enabled", "true")
        if args.threads:
            builder = builder.master(f"local[{args.threads}]")
        spark = builder.getOrCreate()
    try:
        weights = read_weights(spark, args.cfd_weights) if args.cfd_weights else None
        every = read_guides(spark, args.sequence) if args.sequence else guides([args.guide])
        how = {"upstream": args.upstream, "distance": args.cluster_distance, "criteria": args.prioritization_criteria, "weights": weights}
        if args.command == "search":
            found = search_reference_many(spark, args.fasta, every, args.pam, caps, annotations=args.annotation, annotation_names=args.annotation_colnames, **how)
        else:
            found = {g: search_assemblies(spark, args.assemblies, args.chains, g, args.pam, caps, tolerance=args.ambiguity_tolerance, **how) for g in every}
        for guide, both in found.items():
            prefix = report_prefix(guide, args.pam, args.output_prefix if len(every) == 1 else None)
            for path in write_partitions(*both, args.output, prefix):
                log.info("wrote %s", path)
    except ValueError as e:
        log.error("%s", e)
        return 65
    log.info("done in %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
