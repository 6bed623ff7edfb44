"""Patterns, their structure, and join orders."""
