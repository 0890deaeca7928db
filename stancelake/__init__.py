"""Stance-aware text analytics expressed as Spark DataFrame plans."""
