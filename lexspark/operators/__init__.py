"""operators of lexspark."""
