"""Streams of changed paths."""
