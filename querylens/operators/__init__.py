"""DataFrame operators on the slow-log tables."""
