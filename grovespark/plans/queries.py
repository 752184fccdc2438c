"""All queries of the file-tree operators."""

from __future__ import annotations

from grovespark.plans import catalog, round_trips  # noqa: F401
from grovespark.plans.registry import QUERIES, SQL  # noqa: F401
