"""End-to-end jobs and the named queries."""
