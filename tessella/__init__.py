"""Tessella: spatial range counting and workload-aware placement on PySpark."""
