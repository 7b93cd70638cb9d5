"""Ordered symbol sequences and time-aligned intervals on Spark DataFrames."""
