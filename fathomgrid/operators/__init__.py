"""fathomgrid operators."""
