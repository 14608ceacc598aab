"""functions of the cartulary engine."""
