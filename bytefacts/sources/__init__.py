"""Artifacts in, records out."""
