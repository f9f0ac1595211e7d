"""Registered queries, each with the SQL that must give the same rows."""

from telemill.plans import fleet, quality, relational, storage, timeseries  # noqa: F401
from telemill.plans.registry import ORACLES, QUERIES  # noqa: F401
