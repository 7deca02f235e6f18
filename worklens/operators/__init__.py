"""operators of worklens."""
