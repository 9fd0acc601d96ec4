"""All queries of the engine and their SQL."""

from eventloom.plans import recordings, values  # noqa: F401  registers them
from eventloom.plans.registry import QUERIES, SQL  # noqa: F401
