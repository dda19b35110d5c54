"""Registered queries with their SQL, by topic."""
