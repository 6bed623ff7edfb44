"""Candidate filtering, pattern matching, peeling and data-parallel primitives."""
