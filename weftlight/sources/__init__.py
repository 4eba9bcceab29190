"""Readers, schemas, sinks and generators."""
