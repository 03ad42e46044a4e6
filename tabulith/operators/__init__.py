"""Operators on papers, pages and tables; each takes and gives DataFrames."""
