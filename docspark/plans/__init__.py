"""Whole plans: ingest, query, benchmark; and the driver's queries."""
