"""Operators over quads, evidence, jobs, chunks and vectors, each a DataFrame to a DataFrame."""
