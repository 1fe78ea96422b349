"""Lattica: a semantic drill-across analytics engine on Spark DataFrames."""
