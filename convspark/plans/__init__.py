"""Registered queries with their SQL, and the tables they derive from the test data."""
