"""Scorers and embedders: pluggable, with defaults that need no model."""
