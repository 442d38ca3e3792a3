"""Readers and writers for the catalog tables, image folders, exports and trained heads."""
