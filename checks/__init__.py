"""Queries of the driver contract and the SQL they are checked against."""
