"""Where elements come from and where an index lives."""
