"""Operators over entity sets, key/value stores and bitmaps."""
