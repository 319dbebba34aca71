"""sources of lexspark."""
