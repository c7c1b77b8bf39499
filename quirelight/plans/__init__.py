"""Query plans over the driver's tables."""

from quirelight.plans import catalogue2  # noqa: F401  adds to the catalogue
from quirelight.plans.catalogue import QUERIES, SQL


def all_queries() -> tuple[dict, dict]:
    """Queries by name, and the SQL of those that SQL can express."""
    return dict(QUERIES), dict(SQL)
