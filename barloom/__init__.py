"""Equity screening and evidence operators as Spark DataFrame plans."""
