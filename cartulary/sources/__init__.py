"""sources of the cartulary engine."""
