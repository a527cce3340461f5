"""Sources of the wave-field library."""
