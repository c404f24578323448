"""All named queries; importing a module registers its part."""

from __future__ import annotations

import importlib
import pkgutil

from .base import ORACLES, QUERIES


def load():
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
