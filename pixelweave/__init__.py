"""Consensus detection over labelled image regions, as Spark DataFrames."""
