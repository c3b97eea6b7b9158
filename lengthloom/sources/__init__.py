"""Adapters from tables and files to the engine's schemas."""
