"""fathomgrid streaming."""
