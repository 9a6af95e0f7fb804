"""Registered queries over the test tables, with the SQL that checks them."""

from equityjobs.catalog import compare, coverage, jobs, lifecycle, peers, prices, reports, streams, terms  # noqa: F401
from equityjobs.catalog.registry import ORACLE_SQL, QUERIES  # noqa: F401
