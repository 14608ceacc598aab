"""plans of the cartulary engine."""
