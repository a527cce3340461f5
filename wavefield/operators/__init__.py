"""Operators of the wave-field library."""
