"""Readers, sinks and driver-table adapters."""
