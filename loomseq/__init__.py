"""Genome-scale off-target search and the relational work around it, as Spark plans."""
