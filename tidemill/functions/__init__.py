"""Column functions and bit-level codecs."""
