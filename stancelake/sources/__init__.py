"""Readers: files and exports to units, one row a section or turn."""
