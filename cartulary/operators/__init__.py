"""operators of the cartulary engine."""
