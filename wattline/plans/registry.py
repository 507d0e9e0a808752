"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

import wattline.plans as plans
from wattline.plans.base import ORACLES, QUERIES, finish

for _m in pkgutil.iter_modules(plans.__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"wattline.plans.{_m.name}")

finish()

__all__ = ["ORACLES", "QUERIES"]
