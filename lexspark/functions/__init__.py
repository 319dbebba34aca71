"""functions of lexspark."""
