"""Streams of quads into a store."""
