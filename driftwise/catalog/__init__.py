"""Named queries (one Spark job each, with a DuckDB oracle where SQL can express it)."""

from driftwise.catalog.base import REGISTRY, Entry, register  # noqa: F401
from driftwise.catalog import (  # noqa: F401
    decision,
    drift,
    evaluation,
    features,
    models,
    monitoring,
    ops,
    profiles,
    streaming,
    text,
    validation,
)


def queries():
    return {name: e.fn for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.sql for name, e in REGISTRY.items() if e.sql}
