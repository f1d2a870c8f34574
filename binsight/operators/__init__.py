"""Reusable operators (filters, sequences, duplicates, totals, presence,
interval matching, clock repair, sinks).  Every function takes and returns
DataFrames; column names are parameters."""
