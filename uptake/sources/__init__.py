"""Readers, header handling, sheet layouts and sinks."""
