"""Readers, writers and optional back ends."""
