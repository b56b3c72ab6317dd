"""Plans of the spatial engine."""
