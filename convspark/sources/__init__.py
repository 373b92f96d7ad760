"""Readers, writers and dataset upkeep."""
