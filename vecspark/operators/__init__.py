"""Relational operators over vectors, graphs, cells and traces."""
