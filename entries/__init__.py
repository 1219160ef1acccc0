"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from entries import cleaning, profiling, records
from entries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "profiling", "records"]
