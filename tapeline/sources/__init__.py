"""Readers and writers for bars, journals, logs and data sets."""
