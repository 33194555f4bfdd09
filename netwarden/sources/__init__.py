"""Readers and writers for flow files, alert logs and fitted artifacts."""
