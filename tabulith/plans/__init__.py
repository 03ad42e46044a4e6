"""Tabulith plans."""
