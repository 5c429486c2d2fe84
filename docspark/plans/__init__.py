"""Whole plans over a corpus."""
