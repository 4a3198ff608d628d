"""Registered queries on the shared test tables."""

from importlib import import_module

from .base import ORACLES, QUERIES, Query

SECTIONS = ("names", "warehouse", "folders", "match", "corpus")
for _section in SECTIONS:
    import_module(f"{__name__}.{_section}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
