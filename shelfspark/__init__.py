"""Catalog-quality and pricing analytics as composable Spark DataFrame functions."""
