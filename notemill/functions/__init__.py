"""Part of the notemill engine."""
