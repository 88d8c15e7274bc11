"""Continuous imports; an extension, as the catalog's own imports are batches."""
