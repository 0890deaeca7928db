"""Whole queries: plans built from the operators, the facade, and the catalogue with its SQL."""
