"""Column functions: terms, numeric keys, 64-bit words of bitmaps."""
