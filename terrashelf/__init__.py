"""Catalogue of donated geographic files as Spark jobs: DataFrames in, DataFrames out."""
