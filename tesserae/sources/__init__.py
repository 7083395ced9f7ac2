"""Scans and sinks of catalog data."""
