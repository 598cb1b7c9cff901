"""Pandas-parity table operators, dataset comparison and evidence analytics on Spark."""
