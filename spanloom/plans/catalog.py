"""All registered queries."""

from __future__ import annotations

from functools import cache

from . import catalog_intake, catalog_otlp, catalog_sources, catalog_series, catalog_store, catalog_tables
from .registry import Registry


@cache
def catalog() -> Registry:
    reg = Registry()
    catalog_tables.register(reg)
    catalog_series.register(reg)
    catalog_intake.register(reg)
    catalog_otlp.register(reg)
    catalog_sources.register(reg)
    catalog_store.register(reg)
    return reg
