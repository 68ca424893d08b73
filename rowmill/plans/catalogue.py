"""All registered queries; importing the groups fills the registry."""

from rowmill.plans import (  # noqa: F401
    browsing,
    checking,
    cleaning,
    discovering,
    evidencing,
    files,
    intaking,
    loading,
    profiling,
    records,
    streams,
    structuring,
)
from rowmill.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
