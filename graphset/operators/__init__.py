"""Operators over tables of vertices, edges, tokens and fingerprints."""
