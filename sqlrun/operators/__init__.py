"""Reusable operators built from DataFrame primitives (coverage, multiplicity)."""
