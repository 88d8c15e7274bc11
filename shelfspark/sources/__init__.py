"""Readers: product views, spreadsheets and delimited grids."""
