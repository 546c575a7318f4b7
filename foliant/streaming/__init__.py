"""The same plan over files as they arrive."""
