"""Keyed stateful streams, and their batch twins."""
