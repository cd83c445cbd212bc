"""Readers: delimited text, XML folders, and the catalog of existing tables."""
