"""Training-data operators over text tables. Nothing else in the package imports this."""
