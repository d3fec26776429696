"""Scans, schema checks and the panels built from the base tables."""
