"""Operators over quads, dictionaries, bitmaps and indexes; DataFrames in, DataFrames out."""
