"""Part of the evidence engine."""
