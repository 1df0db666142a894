"""fathomgrid sources."""
