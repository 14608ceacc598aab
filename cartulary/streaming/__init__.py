"""streaming of the cartulary engine."""
