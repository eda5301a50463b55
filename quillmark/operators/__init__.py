"""Relational operators over tenders: each takes and returns DataFrames."""
