"""The operators bound to the test tables, each next to the SQL that must agree with it."""

from cartulary.plans import (  # noqa: F401
    functions,
    intervals,
    io,
    outline,
    pages,
    proofs,
    recipes,
    reports,
    versions,
)
from cartulary.plans.registry import QUERIES  # noqa: F401
