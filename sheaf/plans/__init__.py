"""Every registered query, by operator group."""

from sheaf.plans import annotations, assembly, cleaning, evaluation, ingest, links
from sheaf.plans import modelling, records, relevance, reports  # noqa: F401
from sheaf.plans.registry import ORACLES, QUERIES  # noqa: F401
