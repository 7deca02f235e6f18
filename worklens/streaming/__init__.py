"""streaming of worklens."""
