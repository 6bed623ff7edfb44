"""Graphs from text, tables and files, and shared storage for intermediate tables."""
