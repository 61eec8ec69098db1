"""Functions over whole results."""
