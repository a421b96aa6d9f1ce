"""Incremental and streaming drivers."""
