"""Incremental maintenance of the edge and count tables."""
