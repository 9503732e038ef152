"""Landed inputs that the registered queries derive from the given tables."""
