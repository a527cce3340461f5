"""Plans of the wave-field library."""
