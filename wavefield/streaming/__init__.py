"""Streaming of the wave-field library."""
