"""Arbora: a property-graph analytics engine that runs openCypher on Spark DataFrames."""
