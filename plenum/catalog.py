"""All queries of the library and the SQL that gives the same rows."""

from .plans import decision, interval, live, measures, relational, search, sources, text  # noqa: F401  each registers its queries
from .plans.registry import ORACLES, QUERIES  # noqa: F401
