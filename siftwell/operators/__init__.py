"""DataFrame operators on design matrices and selection tables."""
