"""Readers, verified snapshots and sinks."""
