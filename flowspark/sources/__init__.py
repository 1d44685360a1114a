"""Readers and decoders that produce the record types of ``schemas``."""
