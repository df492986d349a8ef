"""Reports of a result document."""
