"""Whole loads: from an input to a written table."""
