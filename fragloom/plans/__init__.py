"""Registered queries and their SQL."""

from . import files, registry  # noqa: F401  the modules register their queries
from .registry import QUERIES, SQL  # noqa: F401
