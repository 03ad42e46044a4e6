"""Tabulith: structured records out of tables embedded in documents, as Spark plans."""
