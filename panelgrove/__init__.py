"""Spark jobs for factor research on price panels, and for preparing text corpora."""
