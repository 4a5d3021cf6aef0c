"""Affect analytics over text, expressed as Spark DataFrame plans."""
