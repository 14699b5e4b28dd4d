"""Registered queries over the star-schema tables, each with a SQL twin where SQL can express it."""
