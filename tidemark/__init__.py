"""Incremental data builds on Spark: partition refresh, history tables, checks, profiles and lineage."""
