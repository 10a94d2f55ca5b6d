"""Registered queries over the driver tables, the fixture tables they read, and their DuckDB counterparts."""
