"""Detection and masking of personal data in tables of text, on Spark."""
