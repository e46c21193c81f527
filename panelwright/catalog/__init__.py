"""Registered queries over the Parquet tables, one module per operator family."""

import importlib
import pkgutil

from panelwright.catalog.base import COMPLETE, QUERIES, SQL, on_complete_dates

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_m}")
SQL.update({n: on_complete_dates(SQL[n]) for n in COMPLETE})

__all__ = ["QUERIES", "SQL"]
