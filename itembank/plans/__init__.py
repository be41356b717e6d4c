"""All registered queries."""

from itembank.plans import (  # noqa: F401
    extraction,
    generate,
    layout,
    reports,
    review,
    repository,
    scalars,
    segment,
    streaming,
)
from itembank.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
