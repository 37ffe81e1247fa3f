"""Queries over the driver tables, each beside the SQL that checks it."""
