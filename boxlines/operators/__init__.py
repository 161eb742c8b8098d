"""DataFrame operators on diagram tables."""
