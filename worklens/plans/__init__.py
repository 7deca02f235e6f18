"""plans of worklens."""
