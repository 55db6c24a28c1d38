"""Catalogue intelligence and text processing, as Spark plans."""
