"""The registered jobs and their SQL counterparts."""

from cuelake.plans import (  # noqa: F401 - they register their jobs
    catalog_jobs,
    cue_jobs,
    document_jobs,
    gate_jobs,
)
from cuelake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
