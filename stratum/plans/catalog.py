"""Registered queries and their SQL."""

from stratum.plans import large, relational, systems  # noqa: F401: importing the others registers their queries

QUERIES = dict(relational.QUERIES)
SQL = dict(relational.SQL)
