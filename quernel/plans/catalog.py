"""All queries over the harness tables, and the SQL that gives the same rows."""

from __future__ import annotations

from quernel.plans import assembly, builds, choices, curation, datasets, evaluation, selection, tables
from quernel.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly", "builds", "choices", "curation", "datasets", "evaluation", "selection", "tables"]
