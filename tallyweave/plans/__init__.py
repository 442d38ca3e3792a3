"""Test-domain views and the registry that pairs every query with its SQL twin."""
