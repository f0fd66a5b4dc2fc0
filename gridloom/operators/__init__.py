"""Relational operators with spreadsheet semantics, as DataFrame compositions."""
