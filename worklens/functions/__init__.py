"""functions of worklens."""
