"""Structured Streaming over recordings that are still growing."""
