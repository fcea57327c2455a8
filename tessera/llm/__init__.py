"""Training-data operators: ten corpus operators that share the block helpers in this package."""
