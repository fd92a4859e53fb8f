"""Readers and writers: file discovery, peer catalogs, exports, telemetry files."""
