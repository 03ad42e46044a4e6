"""Readers, writers and adapters at the engine's edges."""
