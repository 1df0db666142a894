"""fathomgrid plans."""
