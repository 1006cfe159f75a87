"""Relational operators over product data; each takes and returns DataFrames."""
