"""Labelled-collection curation and classifier evaluation as Spark jobs."""
