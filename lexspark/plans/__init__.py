"""plans of lexspark."""
