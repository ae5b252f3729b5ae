"""Scalar building blocks: hash families, byte hashes, distances, and lineage cutting."""
