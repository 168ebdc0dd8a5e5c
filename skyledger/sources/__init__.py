"""Catalog, sidecar, JSON and object sources, and the sinks."""
