"""Documents and templates as tables."""
