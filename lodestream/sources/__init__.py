"""Readers with explicit schemas, a sampling stream source, and sinks."""
