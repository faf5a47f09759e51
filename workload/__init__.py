"""Catalogue tables derived from the TPC-H-like parquet tables, and the queries registered on them."""
