"""Scans, sinks and the adapter for the driver tables."""
