"""Named queries over the supplied tables, by area; importing this package registers all of them."""

from . import sessions  # noqa: F401  (first: holds the flagship)
from . import browse, catalogue, dialects, entities, habits, library, lookups, matching, naming, relational, reports, rescans, rules, shelves  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
