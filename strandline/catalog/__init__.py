"""Registered queries by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["sequencing", "splitting", "detecting", "vectors", "templating", "sampling", "files", "modelling"]


def all_registries():
    return [import_module(f"strandline.catalog.{area}").registry for area in AREAS]
