"""Operators bound to the given tables, with equivalent SQL where there is one."""

from __future__ import annotations

import importlib

AREAS = ["features", "harmonizing", "series", "soils", "geometry", "rasters", "catalogue", "models", "jobs", "shapes"]


def load():
    """(queries, sql), all areas imported."""
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    from loamframe.bindings import tables

    return tables.QUERIES, tables.SQL
