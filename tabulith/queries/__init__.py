"""Queries of the table engine over the star schema, each with the SQL that states its result."""
