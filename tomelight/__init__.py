"""Catalogue analytics on PySpark: rules, facets, reports, entity resolution, change data."""
