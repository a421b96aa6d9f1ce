"""Readers, adapters and schemas of the tables."""
