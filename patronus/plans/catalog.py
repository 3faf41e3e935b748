"""All registered queries and their oracle statements."""

from __future__ import annotations

# Importing a plan module registers its queries.
from patronus.plans import customers  # noqa: F401
from patronus.plans import dashboards  # noqa: F401
from patronus.plans import revenue  # noqa: F401
from patronus.plans import clusters  # noqa: F401
from patronus.plans import training  # noqa: F401
from patronus.plans import neighbours  # noqa: F401
from patronus.plans import evaluation  # noqa: F401
from patronus.plans import models  # noqa: F401
from patronus.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
