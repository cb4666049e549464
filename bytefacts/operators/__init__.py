"""Operators over fact frames."""
