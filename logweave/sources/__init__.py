"""Scans and sinks: text logs, markdown corpora, label caches, driver tables."""
