"""Providers of market panels, readers of record files, and sinks."""
