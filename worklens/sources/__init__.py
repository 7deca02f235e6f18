"""sources of worklens."""
