"""Named query plans over the standard tables, each with the SQL that states the same rows."""

from brindle.plans import relational, scalar, shop, sources, streams  # noqa: F401
from brindle.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
