"""Functions of the wave-field library."""
