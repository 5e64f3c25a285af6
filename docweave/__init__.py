"""Spark jobs over document collections: chunking, indexing, batch search, ranking,
quality and governance scans, and retrieval evaluation. Every job takes DataFrames
and returns a DataFrame."""
