"""Loomcast: workload time-series analytics expressed as Spark plans."""
