"""All registered queries."""
from importlib import import_module

MODULES = ("scans", "filters", "joins", "aggregates", "windows", "scalars", "folds", "search", "publishing", "streams", "udfs")


def _load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from . import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
