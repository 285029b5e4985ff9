"""Text and corpus operators for training-data preparation (nine problems)."""
