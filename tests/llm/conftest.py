"""The session comes from tests/conftest.py."""
