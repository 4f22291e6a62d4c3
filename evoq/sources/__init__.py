"""Readers and writers for manifests, tables, labels, sidecars and signals."""
