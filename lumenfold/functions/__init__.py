"""Part of the record engine."""
