"""Part of the consensa engine."""
