"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from . import (  # noqa: F401
    aggregates,
    changes,
    jobs,
    joins,
    page_extracts,
    scalars,
    selections,
    stores,
)
from .registry import ORACLES, QUERIES  # noqa: F401
