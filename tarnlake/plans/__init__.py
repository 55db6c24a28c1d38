"""Registered queries and the SQL they equal."""
