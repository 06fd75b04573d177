"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

from importlib import import_module
from importlib.util import find_spec

QUERY_MODULES = ("boilerplate_queries", "mojibake_queries", "ledger_queries", "packing_queries", "mixing_queries", "toxicity_queries")


def query_modules() -> list:
    """Modules of this subpackage with registered QUERIES and SQL."""
    return [import_module(f"{__name__}.{m}") for m in QUERY_MODULES if find_spec(f"{__name__}.{m}")]
