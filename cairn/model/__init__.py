"""Schemas of the engine's records."""
