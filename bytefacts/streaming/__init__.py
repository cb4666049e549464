"""Structured Streaming over artifacts; beyond what is asked of batch use."""
