"""fathomgrid functions."""
