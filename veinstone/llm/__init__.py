"""Training-data operators: filtering, deduplication, scoring, packing.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, selects the columns it needs by name (so extra columns never
clash) and defines its result for null, empty and very long texts.
"""
