"""Panel preparation and the reports built on it."""
