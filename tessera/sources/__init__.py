"""Connectors, record parsers, settings and exports."""
