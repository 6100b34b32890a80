"""Registered queries: each pairs a DataFrame program with an equivalent SQL text."""
