"""Netlist timing analytics, retrieval and advice as Spark DataFrames."""
